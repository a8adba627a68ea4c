"""Filling fixed-capacity containers with texts of varying length, by tiers.

Containers of one capacity are cut into windows of several context sizes, halves of each
other (the tiers). A text is routed to the smallest window that holds ROUTE of its like, so
that windows can be filled well, and texts too long for that go to the longest window. Each
tier is packed on its own, from the longest window down: the longest text left opens a
window, the tier's own texts fill it as long as one fits, and the gap that is left is
filled with the longest texts of shorter tiers that fit. Windows are then laid into
containers, longest first; as they are halves of each other, they fill them without a gap.

Containers are dealt to step groups such that groups hold windows of all tiers alike and
about the same work (tokens squared, as attention costs).

Shards are even because their number follows the total size and a row's shard comes from a
hash of its key; each leaves one container and one window of a tier partly empty at most in
practice. Only keys and sizes are exchanged, never texts.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.tokens import DEFAULT_VOCABULARY, token_spans
from quire.session import settle

CAPACITY = 2048
#: The shortest window.
SMALLEST = 128
#: A window of a tier holds so many of the tier's texts at least.
ROUTE = 2
#: Tokens a shard aims at; with it a shard's task holds some thousands of rows.
SHARD_TOKENS = 4_000_000
#: Containers in one step group.
STEP_GROUP = 16


def tiers(capacity: int, smallest: int = SMALLEST) -> list[int]:
    """Windows from `capacity` down by halves, not below `smallest`; a capacity that can't be
    halved evenly is the last."""
    out = [capacity]
    while out[-1] % 2 == 0 and out[-1] // 2 >= smallest:
        out.append(out[-1] // 2)
    return out


def route(size: int, windows: list[int]) -> int:
    """The window a text belongs to: the shortest that holds ROUTE texts of its size, else
    the longest."""
    return min((w for w in windows if w >= ROUTE * size), default=max(windows))


class Waiting:
    """Items of one tier by size: the longest that fits is taken first."""

    def __init__(self) -> None:
        self.by_size: dict[int, deque[int]] = {}
        self.sizes: list[int] = []

    def add(self, size: int, item: int) -> None:
        if size not in self.by_size:
            self.by_size[size] = deque()
            insort(self.sizes, size)
        self.by_size[size].append(item)

    def longest(self, room: int) -> int:
        """The longest size up to `room`; 0 if there is none."""
        k = bisect_right(self.sizes, room)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int) -> int:
        item = self.by_size[size].popleft()
        if not self.by_size[size]:
            del self.by_size[size]
            self.sizes.remove(size)
        return item


def fill(sizes: list[int], windows: list[int]) -> list[tuple[int, list[int], int]]:
    """Windows as (size, positions of `sizes`, how many of them came from shorter tiers).

    Every position with a size up to the longest window comes out exactly once; a window
    never exceeds its size. What a tier's own texts leave open is filled from the next
    shorter tier, then from the one below it.
    """
    waiting = {w: Waiting() for w in windows}
    for i, n in enumerate(sizes):
        if not 0 < n <= windows[0]:
            raise ValueError(f"size {n} doesn't fit a window of {windows[0]}")
        waiting[route(n, windows)].add(n, i)
    out = []
    for k, w in enumerate(windows):
        own = waiting[w]
        while own.sizes:
            room, inside, guests = w, [], 0
            for source in windows[k:]:
                while n := waiting[source].longest(room):
                    inside.append(waiting[source].take(n))
                    room -= n
                    guests += source != w
            out.append((w, inside, guests))
    return out


def lay(windows: list[int], capacity: int) -> list[tuple[int, int]]:
    """(container, offset) of windows given longest first; each divides the longer ones and
    the capacity, so that a container is full before the next is opened."""
    out, container, at = [], 0, 0
    for w in windows:
        if at + w > capacity:
            container, at = container + 1, 0
        out.append((container, at))
        at += w
    return out


def step_groups(work: list[int], kinds: list[int], group: int) -> list[int]:
    """A group number for each container such that all groups hold kinds alike and about the
    same work: containers by kind and descending work are dealt out back and forth."""
    n = max(1, -(-len(work) // group))
    out = [0] * len(work)
    for rank, i in enumerate(sorted(range(len(work)), key=lambda i: (-kinds[i], -work[i], i))):
        lap, at = divmod(rank, n)
        out[i] = at if lap % 2 == 0 else n - 1 - at
    return out


PLACES = ("container", "window_at", "window", "tier", "slot", "step_group")


def pack_sizes(items: DataFrame, keys: list[str], size: str, capacity: int, shards: int, group: int = STEP_GROUP, smallest: int = SMALLEST) -> DataFrame:
    """`items` (keys, size) plus shard, container, window_at (where the window starts in its
    container), window (its size), tier (the window the text was routed to; longer windows
    than that were filled with it), slot and step_group.

    Items of null or zero size take no room and are left out here; a size beyond the
    capacity is an error, as only the caller can cut. Repeated rows are items of their
    own. The keys decide the shard, and order items of equal size.
    """
    windows = tiers(capacity, smallest)
    src = items.filter(F.col(size) > 0).select(*keys, size).withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    schema = T.StructType([*src.schema, *(T.StructField(c, T.IntegerType()) for c in PLACES)])
    order = [(k, "ascending") for k in keys]

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(size, "descending"), *order])
        sizes = rows[size].to_pylist()
        packed = fill(sizes, windows)
        places = lay([w for w, _, _ in packed], capacity)
        n = places[-1][0] + 1 if places else 0
        work, kinds = [0] * n, [0] * n
        for (w, inside, _), (c, _) in zip(packed, places):
            work[c] += sum(sizes[i] ** 2 for i in inside)
            kinds[c] = max(kinds[c], w)
        groups = step_groups(work, kinds, group)
        found = [(0,) * len(PLACES)] * len(sizes)
        for (w, inside, _), (c, at) in zip(packed, places):
            for slot, i in enumerate(inside):
                found[i] = (c, at, w, route(sizes[i], windows), slot, groups[c])
        for name, values in zip(PLACES, zip(*found) if found else [()] * len(PLACES)):
            rows = rows.append_column(name, pa.array(values, pa.int32()))
        return rows

    return src.groupBy("shard").applyInArrow(pack, schema)


def pack_documents(
    documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS, smallest: int = SMALLEST
) -> DataFrame:
    """Place every text into containers of `capacity` tokens.

    One row for each piece: key, piece_no, n_pieces, char_start, char_end, tokens, shard and
    the columns of pack_sizes. (shard, container) names a container. A text is in one piece
    unless it alone exceeds the capacity; pieces cover it without gap or overlap. Null and
    empty texts come out with n_pieces 0, no piece and no container. Repeated keys are
    separate texts of which pieces share the key. Other columns are ignored.
    """
    spans = documents.select(F.col(key), token_spans(F.col(text), capacity, vocabulary).alias("spans"))
    pieces = settle(spans.select(key, F.size("spans").alias("n_pieces"), F.posexplode_outer("spans").alias("piece_no", "span")).select(key, "n_pieces", "piece_no", "span.*"), "pieces")
    total = pieces.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    keys = [key, "piece_no", "n_pieces", "char_start", "char_end"]
    placed = pack_sizes(pieces.filter("tokens > 0"), keys, "tokens", capacity, shards, smallest=smallest)
    empty = pieces.filter("tokens is null or tokens = 0").select(*keys, "tokens")
    return placed.unionByName(empty, allowMissingColumns=True)


def oversized(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the texts that were placed in more than one container. Pieces of a text but
    the last fill a container each, so a text is here just if it alone exceeds one."""
    places = packed.filter("n_pieces > 1").groupBy(key).agg(F.count_distinct("shard", "container").alias("n"))
    return places.filter("n > 1").select(key)


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each window size, and one with a null window for all: windows, texts, texts
    that came from a shorter tier, tokens, utilisation of the windows (for all: of the
    containers), and the number of containers (for all)."""
    placed = packed.filter("container is not null")
    sums = [F.count(F.lit(1)).alias("texts"), F.sum((F.col("tier") < F.col("window")).cast("bigint")).alias("filled_in"), F.sum("tokens").cast("bigint").alias("tokens")]
    per = placed.groupBy("shard", "container", "window_at", "window").agg(*sums)
    each = per.groupBy("window").agg(F.count(F.lit(1)).alias("windows"), *[F.sum(c).alias(c) for c in ("texts", "filled_in", "tokens")])
    each = each.select("*", (F.col("tokens") / (F.col("windows") * F.col("window"))).alias("utilisation"), F.lit(None).cast("bigint").alias("containers"))
    whole = per.groupBy("shard", "container").agg(F.count(F.lit(1)).alias("windows"), *[F.sum(c).alias(c) for c in ("texts", "filled_in", "tokens")])
    whole = whole.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("windows", "texts", "filled_in", "tokens")], F.count(F.lit(1)).alias("containers"))
    return each.unionByName(whole.select(F.lit(None).cast("int").alias("window"), "*", F.try_divide(F.col("tokens"), F.col("containers") * F.lit(capacity)).alias("utilisation")))
