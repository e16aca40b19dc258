"""Prefix trie of conversations by distributed most-significant-digit radix partitioning.

Turns become ids (a dictionary: the number of the first row that has the same role and text, told by SHA-256), so texts
move no further than their digest. A bucket holds the conversations that share a prefix. A bucket of more than `LOCAL` rows is
split by Spark: one aggregate by depth finds how far all its members agree (a chain of nodes, whatever its length, in
one round), then its members are dealt out by the id at the depth where they part. A smaller bucket goes to one task, where
multikey quicksort sorts the rest of its sequences and emits a node whenever it has gathered those of equal id. Sums over
subtrees come back along the large buckets' paths.

Scale. Conversations are rebuilt by one sort by ranges; a range learns from those before it, by a row for each of them, how
its first conversation began. Rounds follow the number of partings among large buckets, not the depth. A conversation of any
length is never gathered: joins are by conversation and 1,024 turns, buckets are salted, and a prefix sum of bytes along each
conversation gives a chain's sums without one. Ids that end at a node of a large bucket are hashed in pieces in order, since
SHA-256 has no parts.

Cases: rows without conv_id belong to no conversation and are left out; null roles and texts are empty; turns in order, null
first, rows of one turn by role, then by digest; repeated rows are turns of their own; very long texts are read whole, once;
conversations without turns are members of the root; an empty table has no conversations and so no root: an empty result;
other columns than conv_id, turn, role and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpointed, schema_of, sha256
from quillmesh.operators.graph import PARTS, with_least
from quillmesh.operators.parallel import few, spread

#: Rows (turns and conversations) of a bucket that one task finishes.
LOCAL = 20_000
#: Turns of a conversation that a join may bring together.
SPAN = 1024
#: Characters of ids that are hashed at a time.
PIECE = 1 << 20
#: Conversations of this many neighbouring ids begin with the turns of the first, up to SHARED of them.
FAMILY, SHARED = 5, 8
NO_IDS = sha256(b"")

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
TURNS = "conv_id long, depth long, told binary, bytes long, cum long"


# ---- conversations rebuilt


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, shared (turns taken from the base), told, bytes, in order, over checkpointed ranges."""
    c = F.col("conv_id")
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    own = spread(conversations.select(c.cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("conv_id is not null"))
    base = c - c % FAMILY
    told = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = own.select(base.alias("base"), "conv_id", F.when(c == base, 0).otherwise(F.crc32(c.cast("string")) % (SHARED + 1)).cast("int").alias("shared"), "turn", "role", told.alias("told"), F.octet_length("text").cast("long").alias("bytes"))
    ordered = rows.orderBy("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "told")
    return checkpointed(ordered.select("base", "conv_id", "shared", "told", "bytes"))


class Rebuilt:
    """Takes the turns of a range in order; holds what the next turn's place depends on."""

    def __init__(self, base=None, lead=(), conv=None, seen=0, own=0):
        self.base, self.lead, self.conv, self.seen, self.own = base, list(lead), conv, seen, own

    def add(self, base: int, conv: int, shared: int, told: bytes, size: int) -> list[tuple]:
        """Rows (TURNS) that a turn adds: itself, and before a conversation's first those of its base."""
        out = []
        if base != self.base:
            self.base, self.lead = base, []
        if conv != self.conv:
            self.conv, self.seen, self.own, total = conv, 0, 0, 0
            for depth, (t, n) in enumerate(self.lead[:shared], 1):
                total += n
                out.append((conv, depth, t, n, total))
        self.seen += 1
        if conv == base and len(self.lead) < SHARED:
            self.lead.append((told, size))
        if self.seen > shared:
            self.own += size
            begun = self.begun(shared)
            out.append((conv, len(begun) + self.seen - shared, told, size, sum(n for _, n in begun) + self.own))
        return out

    def begun(self, shared: int) -> list:
        return self.lead[:shared] if self.conv != self.base else []

    def length(self, shared: int) -> int:
        return len(self.begun(shared)) + max(0, self.seen - shared)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range in a row: its first conversation (rows, bytes, first turns) and the state behind its last, as far as the range knows it."""
    first, n, size, lead, state = None, 0, 0, [], Rebuilt()
    for base, conv, shared, told, byte in _columns(batches):
        if first is None:
            first = (base, conv, shared)
        if conv == first[1]:
            n, size = n + 1, size + byte
            if len(lead) < SHARED:
                lead.append((told, byte))
        state.add(base, conv, shared, told, byte)
    if first is not None:
        row = (TaskContext.get().partitionId(), *first, n, size, lead, state.base, state.lead, state.conv, state.seen, state.own)
        turns = pa.list_(pa.struct([("told", pa.binary()), ("bytes", pa.int64())]))
        kinds = [pa.int64()] * 6 + [turns, pa.int64(), turns, pa.int64(), pa.int64(), pa.int64()]
        held = [[{"told": t, "bytes": b} for t, b in v] if isinstance(v, list) else v for v in row]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(held, kinds, strict=True)], [f"s{i}" for i in range(12)])


def carried(rows: DataFrame) -> dict[int, tuple]:
    """For each range the state before it, and whether its last conversation ends in it: a row for each range comes to the driver."""
    listed = "array<struct<told binary, bytes long>>"
    ddl = ", ".join(f"s{i} {listed if i in (6, 8) else 'long'}" for i in range(12))
    found = sorted(rows.mapInArrow(_summaries, ddl).collect(), key=lambda r: r[0])
    out, state = {}, Rebuilt()
    for i, (here, base, conv, shared, n, size, lead, last_base, last_lead, last, seen, own) in enumerate(found):
        out[here] = ((state.base, state.lead, state.conv, state.seen, state.own), i + 1 == len(found) or found[i + 1][2] != last)
        lead = [(bytes(t.told), t.bytes) for t in lead]
        known = state.lead if state.base == base else []
        before, had = (state.seen, state.own) if state.conv == conv else (0, 0)
        if conv == base:
            known = (known + lead)[:SHARED]
        if last == conv:
            skipped = min(max(0, shared - before), n)
            seen, own = before + n, had + size - sum(b for _, b in lead[:skipped])
        state = Rebuilt(last_base, known if last_base == base else [(bytes(t.told), t.bytes) for t in last_lead], last, seen, own)
    return out


def _rebuilt(batches: Iterator[pa.RecordBatch], before: dict, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (TURNS) of a range, and, without a digest, one for each conversation that ends in it: its length."""
    held, last = [], None
    state, ends = None, False
    for row in _columns(batches):
        if state is None:
            start, ends = before[TaskContext.get().partitionId()]
            state = Rebuilt(*start)
        if last is not None and last[1] != row[1]:
            held.append((last[1], state.length(last[2]), None, None, None))
        held += state.add(*row)
        last = row
        if len(held) >= 8192:
            yield _batch(held, arrow)
            held = []
    if last is not None and ends:
        held.append((last[1], state.length(last[2]), None, None, None))
    if held:
        yield _batch(held, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, id, bytes, cum: bytes up to here) and conversations (conv_id, len)."""
    rows = sorted_turns(conversations)
    before = rows.sparkSession.sparkContext.broadcast(carried(rows))
    spark_schema, arrow = schema_of(TURNS)
    made = checkpointed(rows.mapInArrow(lambda batches: _rebuilt(batches, before.value, arrow), spark_schema).withColumn("row", F.monotonically_increasing_id()))
    turns = with_least(made.where("told is not null"), "told", "row", "id").select("conv_id", "depth", "id", "bytes", "cum")
    return turns, made.where("told is null").select("conv_id", F.col("depth").alias("len"))


# ---- buckets too large for a task


def salted(rows: DataFrame, table: DataFrame, key: str, by: str = "conv_id", how: str = "inner") -> DataFrame:
    """rows joined with a small table of buckets: sent to every task if it is counted and small, else each bucket's rows in parts."""
    near = few(table)
    if near is not table:
        return rows.join(near, key, how)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    return dealt.join(table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("_part", F.col("_part").cast("long")), [key, "_part"], how).drop("_part")


def nodes(conversations: DataFrame, local: int | None = None) -> DataFrame:
    """NODES of the trie."""
    local = LOCAL if local is None else local
    turns, convs = rebuilt(conversations)
    spark = convs.sparkSession
    convs = checkpointed(convs)
    least = convs.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("len").alias("rows")).first()
    if not least["n"]:
        return spark.createDataFrame([], NODES)
    # of a member: its bucket (b, the least member), the depth that bucket begins at, that node's bytes, and the bucket it came from
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    members = convs.select("conv_id", "len", F.lit(least["least"]).alias("b"), zero.alias("top"), zero.alias("bytes"), zero.alias("cum"), none.alias("of"), none.alias("of_top"))
    members = checkpointed(members)  # so that the planner does not take the root's bucket for a constant and its joins for cross joins
    rows = checkpointed(turns.withColumn("b", F.lit(least["least"])))
    done_members, done_rows, segments, chains, ends = [], [], [], [], []
    live = least["n"] + least["rows"] > local
    if not live:
        done_members, done_rows = [members], [rows]
    paths = spark.createDataFrame([(least["least"], [])], "b long, above array<struct<b:long,top:long>>") if live else None
    while live:
        seg = _agreeing(rows, members, paths)
        within = salted(rows, seg.select("b", F.col("top").alias("from"), "low"), "b")
        chains.append(checkpointed(within.where("conv_id = b and depth <= low").select("b", F.col("from").alias("top"), "depth", "bytes", "cum", "low")))
        segments.append(seg)
        held = salted(members.drop("top"), seg.select("b", "top", "low"), "b")
        ends.append(checkpointed(held.where("len = low").select("b", "top", "conv_id")))
        # one radix step: members by the id at the depth where they part
        parted = with_least(within.where("depth = low + 1").select("conv_id", F.struct("b", "id").alias("key"), "bytes", "cum", "from", "depth"), "key", "conv_id", "to")
        moved = parted.select("conv_id", F.col("to"), F.col("depth").alias("at"), "bytes", "cum", F.col("key.b").alias("of"), F.col("from").alias("of_top"))
        moved = checkpointed(moved.join(members.select("conv_id", "len"), "conv_id"))
        spans = moved.select(F.col("conv_id").alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("len") / SPAN))).alias("_s"), F.col("to").alias("_b"))
        rest = within.where("depth > low + 1")
        rows = checkpointed(rest.join(spans, (rest["conv_id"] == F.col("_c")) & (F.floor(rest["depth"] / SPAN) == F.col("_s"))).select("conv_id", "depth", "id", rest["bytes"], rest["cum"], F.col("_b").alias("b")))
        members = moved.select("conv_id", "len", F.col("to").alias("b"), F.col("at").alias("top"), "bytes", "cum", "of", "of_top")
        sizes = members.select("b").unionByName(rows.select("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        large = checkpointed(sizes.where(F.col("n") > local).select("b", F.lit(True).alias("large")))
        live = not large.isEmpty()
        if not live:
            done_members.append(members)
            done_rows.append(rows)
            break
        split_members, split_rows = salted(members, large, "b", how="left"), salted(rows, large, "b", how="left")
        done_members.append(split_members.where("large is null").drop("large"))
        done_rows.append(split_rows.where("large is null").drop("large"))
        known = seg.select(F.col("b").alias("of"), F.col("top").alias("of_top"), F.array_append("above", F.struct("b", "top")).alias("above"))
        first = salted(members.where("conv_id = b"), large, "b", how="left_semi").select("b", "of", "of_top")
        members, rows = split_members.where("large").drop("large"), split_rows.where("large").drop("large")
        paths = checkpointed(first.join(known, ["of", "of_top"]).select("b", "above"))
    small = _finished(_all(done_members), _all(done_rows))
    if not segments:
        return small.drop("of_top", "is_top")
    small = checkpointed(small)
    return small.drop("of_top", "is_top").unionByName(_upper(_all(segments), _all(chains), _all(ends), small))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _agreeing(rows: DataFrame, members: DataFrame, paths: DataFrame) -> DataFrame:
    """b, top, low (the depth up to which all members agree), n, bytes and cum at the top, cum_low, of, of_top, above: a row for each bucket."""
    count = members.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    at = members.where("conv_id = b").select("b", "top", "bytes", "cum", "of", "of_top")
    levels = rows.groupBy("b", "depth").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("x"), F.max("id").alias("y"), F.min("cum").alias("cum"))
    kept = salted(levels, checkpointed(count), "b", by="depth")
    agreed = (F.col("k") == F.col("n")) & (F.col("x") == F.col("y"))
    low = kept.groupBy("b").agg(F.min(F.when(~agreed, F.col("depth"))).alias("parts"), F.max("depth").alias("deepest"))
    found = at.join(count, "b").join(low, "b", "left").join(paths, "b")
    return checkpointed(found.select("b", "top", F.coalesce(F.col("parts") - 1, "deepest", "top").alias("low"), "n", "bytes", "cum", "of", "of_top", "above"))


def _upper(segments: DataFrame, chains: DataFrame, ends: DataFrame, small: DataFrame) -> DataFrame:
    """NODES of the large buckets: the chain of each, and sums of what lies below."""
    key = ["b", "top"]
    lowest = chains.where("depth = low").select(*key, F.col("cum").alias("cum_low"))
    own = segments.join(lowest, key, "left").withColumn("cum_low", F.coalesce("cum_low", "cum"))
    own = checkpointed(own.withColumn("chain", (F.col("n") - 1) * (F.col("cum_low") - F.col("cum") + F.col("bytes"))))
    tops = small.where("is_top").select(F.col("parent_conv_id").alias("b"), F.col("of_top").alias("top"), "n_leaves", F.col("saved_tokens").alias("saved"))
    below = tops.groupBy(*key).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    more = own.where("of is not null").groupBy(F.col("of").alias("b"), F.col("of_top").alias("top")).agg(F.count(F.lit(1)).alias("segs"))
    facts = own.join(below, key, "left").join(more, key, "left").na.fill(0, ["kids", "leaves", "saved", "segs"])
    facts = checkpointed(facts.withColumn("n_children", F.col("kids") + F.col("segs")).withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves"))))
    # what a bucket holds counts for it and for all above it; its chain for those above alone
    to_self = facts.select(*key, F.col("leaves").alias("l"), F.col("saved").alias("s"))
    to_above = facts.select(F.explode("above").alias("k"), F.col("leaves").alias("l"), (F.col("saved") + F.col("chain")).alias("s")).select("k.b", "k.top", "l", "s")
    sums = to_self.unionByName(to_above).groupBy(*key).agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("beneath"))
    hashed = _hashed(ends)
    full = checkpointed(facts.join(sums, key).join(hashed, key, "left").select(F.struct(*key).alias("seg"), "low", "n", "cum_low", "of", "n_children", "n_leaves", "beneath", "sha"))
    heads = segments.select(F.struct(*key).alias("seg"), F.col("top").alias("depth"), "bytes", "cum")
    each = salted(heads.unionByName(chains.select(F.struct(*key).alias("seg"), "depth", "bytes", "cum")), full, "seg", by="depth")
    is_low, is_top = F.col("depth") == F.col("low"), F.col("depth") == F.col("seg.top")
    return each.select(
        F.col("seg.b").alias("conv_id"), "depth", F.when(is_top, F.col("of")).otherwise(F.col("seg.b")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(is_low, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        ((F.col("n") - 1) * (F.col("cum_low") - F.col("cum") + F.col("bytes")) + F.col("beneath")).alias("saved_tokens"), F.coalesce(F.when(is_low, F.col("sha")), F.lit(NO_IDS)).alias("ends_sha256"),
    )


def _hashed(ends: DataFrame) -> DataFrame:
    """b, top, sha of the ids that end at each bucket's lowest node, in order: joined in pieces by ranges, the pieces hashed in turn."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, None, []]

        def out():
            b, top = held[0]
            return pa.RecordBatch.from_arrays([pa.array([b]), pa.array([top]), pa.array([held[1]]), pa.array([",".join(held[2])])], ["b", "top", "first", "ids"])

        size = 0
        for b, top, conv in _columns(batches):
            if held[0] != (b, top) or size >= PIECE:
                if held[0] is not None:
                    yield out()
                held[:] = [(b, top), conv, []]
                size = 0
            held[2].append(str(conv))
            size += len(held[2][-1]) + 1
        if held[0] is not None:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([sha.hexdigest()])], ["b", "top", "sha"])
        for b, top, _, ids in _columns(batches):
            if at != (b, top):
                if at is not None:
                    yield row()
                at, sha = (b, top), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if at is not None:
            yield row()

    pieces = ends.orderBy("b", "top", "conv_id").mapInArrow(joined, "b long, top long, first long, ids string")
    return pieces.repartition("b", "top").sortWithinPartitions("b", "top", "first").mapInArrow(hashed, "b long, top long, sha string")


# ---- buckets that a task finishes


def sorted_nodes(convs: list[int], ids: list[list[int]], sizes: list[list[int]], top: int, bytes_top: int):
    """Nodes (conv_id, depth, parent's place or -1, n_convs, bytes, ids that end there) of sequences, by multikey quicksort.

    A part of the order shares `k` ids and hangs under a node; it is cut by the id behind them into less, equal and greater
    (a sequence that has ended is least), and the equal ones are a node of their own.
    """
    order = list(range(len(convs)))
    conv, depth, parent, count, size, ends = [min(convs)], [top], [-1], [len(convs)], [bytes_top], [()]
    todo = [(0, len(order), 0, 0)]

    def node(own: list[int], k: int, above: int, of: int) -> int:
        conv.append(min(convs[i] for i in own))
        depth.append(top + k + 1)
        parent.append(above)
        count.append(len(own))
        size.append(sizes[of][k])
        ends.append(())
        return len(conv) - 1

    while todo:
        low, high, k, above = todo.pop()
        if high - low == 1:  # one is left: a chain to its end
            i = order[low]
            for k in range(k, len(ids[i])):
                above = node([i], k, above, i)
            ends[above] = (convs[i], *ends[above])
            continue
        keys = [ids[i][k] if k < len(ids[i]) else -1 for i in order[low:high]]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less, equal, more = [], [], []
        for i, x in zip(order[low:high], keys, strict=True):
            (less if x < pivot else more if x > pivot else equal).append(i)
        order[low:high] = less + equal + more
        first, behind = low + len(less), low + len(less) + len(equal)
        if less:
            todo.append((low, first, k, above))
        if more:
            todo.append((behind, high, k, above))
        if pivot < 0:
            ends[above] = tuple(convs[i] for i in equal) + ends[above]
        else:
            todo.append((first, behind, k + 1, node(equal, k, above, equal[0])))
    return conv, depth, parent, count, size, ends


def bucket_nodes(convs, ids, sizes, top: int, bytes_top: int, of: int | None, of_top: int | None) -> list[tuple]:
    """Rows (NODES, of_top, is_top) of a bucket."""
    conv, depth, parent, count, size, ends = sorted_nodes(convs, ids, sizes, top, bytes_top)
    kids, leaves, saved = [0] * len(conv), [0] * len(conv), [0] * len(conv)
    for i in range(len(conv) - 1, -1, -1):  # children stand behind their parents
        saved[i] += (count[i] - 1) * size[i]
        leaves[i] = leaves[i] or 1
        if i:
            p = parent[i]
            kids[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    hashed = [sha256(",".join(map(str, sorted(e))).encode()) if e else NO_IDS for e in ends]
    return [(conv[i], depth[i], conv[parent[i]] if i else of, count[i], kids[i], leaves[i], saved[i], hashed[i], of_top, i == 0) for i in range(len(conv))]


def _finished(members: DataFrame, rows: DataFrame) -> DataFrame:
    """NODES, of_top, is_top of the buckets that are small."""
    spark_schema, arrow = schema_of(f"{NODES}, of_top long, is_top boolean")
    none = F.lit(None).cast("long")
    heads = members.select("b", "conv_id", none.alias("depth"), none.alias("id"), "bytes", "top", "of", "of_top")
    tails = rows.select("b", "conv_id", "depth", "id", "bytes", none.alias("top"), none.alias("of"), none.alias("of_top"))
    dealt = heads.unionByName(tails).repartition("b").sortWithinPartitions("b", "conv_id", F.asc_nulls_first("depth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, facts, convs, ids, sizes, out = None, (), [], [], [], []
        for b, conv, depth, turn, size, top, of, of_top in _columns(batches):
            if b != at:
                if convs:
                    out += bucket_nodes(convs, ids, sizes, *facts)
                at, facts, convs, ids, sizes = b, (top, size, of, of_top), [], [], []
                if len(out) >= 8192:
                    yield _batch(out, arrow)
                    out = []
            if depth is None:
                convs.append(conv)
                ids.append([])
                sizes.append([])
            else:
                ids[-1].append(turn)
                sizes[-1].append(size)
        if convs:
            out += bucket_nodes(convs, ids, sizes, *facts)
        if out:
            yield _batch(out, arrow)

    return dealt.mapInArrow(run, spark_schema)
