"""Trie of conversation prefixes as the Cartesian tree over the LCP array of sorted conversations.

Turns become fingerprints (128 bits of the SHA-256 of role and text) and are numbered within their
conversation; texts aren't shuffled. A conversation is its sequence of fingerprints, in blocks of ``block_turns``. Where one needs
more than one block, blocks are named by their place among all sorted blocks and the names are put in blocks
again, so the key a conversation is sorted by is short however many turns it has. Sorted conversations are numbered; the
longest common prefix (LCP) of neighbours comes from their keys, block by block from the coarsest names down.

Positions are cut into blocks of ``elements``. Each finds the nearest smaller values of its LCPs with a stack,
merges equal ones and closes the intervals both ends of which lie within; what stays open is its falling prefix minima
and rising suffix minima, each with the sums of what it has swallowed. These block minima are a shorter
sequence on which the same is done again, until one block holds all. An interval is a branching node; a conversation
that is longer than what it shares with its neighbours is a leaf's path. The depths between a
node and its parent are expanded from the first member's blocks. All figures of a node are sums and minima over
its interval: with K(i) the code points in the prefix that conversation i shares with the one before it, the
tokens saved at depth d and below are the sum of K over the interval less those of the shared first d - 1 turns.

No task sees all turns of a conversation, all copies of one, or all children of a node: numbering splits any
run over range partitions, own turns meet their conversation's figures in slices, parents meet children by position, and
ids that end at a node are joined in chunks. SHA-256 has no parallel form, so the chunks of one node pass through
one task as a stream, some eight bytes an id.

Defined cases: a null role or text is empty; turns of equal number (null is the least) follow their role, then the fingerprint, repeated rows
are turns of their own; rows without a conversation id are left out; a conversation that loses all its turns is a member of the root; an empty
table has no node; other columns may have any names; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tierlink.session import materialize

BLOCK_TURNS = 256
ELEMENTS = 1 << 16
SLICE = 4096  # turns of a conversation, or positions of an interval, that meet in one join key
CHUNK = 8192  # ids of one node that are joined at a time
PRINT, NAME = 16, 8  # bytes of a fingerprint and of a block's name
FAMILY = 100  # conversations that share the head of the first of them
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame, order: Sequence[str], same: Sequence[str], value: str | None = None) -> DataFrame:
    """``rows`` sorted, with i (place among all), first (place of the first row equal in ``same``) and, of ``value``, before (sum over earlier rows of that run).

    ``same`` is a beginning of ``order``. Runs may be as long as they like: partitions count on their own, and what runs on into the
    next is carried by one line a partition.
    """
    at = [rows.columns.index(c) for c in same]
    summed = rows.columns.index(value) if value else None
    schema = StructType(list(rows.schema.fields))
    for name in ("__part", "__n", "__run", "__sum"):
        schema = schema.add(name, LongType())
    schema = schema.add("__end", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, start, total, first, last, held = TaskContext.get().partitionId(), 0, 0, 0, None, None, None

        def digest(key: tuple) -> str:
            return hashlib.sha256(repr(key).encode()).hexdigest()

        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            new = np.zeros(k, bool)
            for a in at:
                col = batch.column(a)
                new[1:] |= pc.not_equal(col.slice(1), col.slice(0, k - 1)).to_numpy(zero_copy_only=False)
            head = tuple(batch.column(a)[0].as_py() for a in at)
            new[0] = head != last
            first = head if first is None else first
            last = tuple(batch.column(a)[k - 1].as_py() for a in at)
            heads, which = np.flatnonzero(new), np.cumsum(new) - 1
            own = batch.column(summed).to_numpy(zero_copy_only=False).astype(np.int64) if summed is not None else np.ones(k, np.int64)
            before = np.cumsum(own) - own
            if len(heads):
                of = heads[np.maximum(which, 0)]
                starts = np.where(which >= 0, n + of, start)
                sums = np.where(which >= 0, before - before[of], total + before)
            else:
                starts, sums = np.full(k, start), total + before
            start, total = int(starts[-1]), int(sums[-1] + own[-1])
            if held is not None:
                yield with_end(held, None)
            held = [*batch.columns, pa.array(np.full(k, part, np.int64)), pa.array(np.arange(n, n + k)), pa.array(starts), pa.array(sums)]
            n += k
        if held is not None:
            yield with_end(held, json.dumps({"n": n, "first": digest(first), "last": digest(last), "start": start, "total": total}))

    def with_end(columns: list[pa.Array], end: str | None) -> pa.RecordBatch:
        ends = pa.array([None] * (len(columns[0]) - 1) + [end], pa.string())
        return pa.RecordBatch.from_arrays([*columns, ends], names=schema.names)

    table = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    ends = sorted((r[0], json.loads(r[1])) for r in table.where("__end is not null").select("__part", "__end").collect())  # one a partition
    lines, base, last, last_first, carried = [], 0, None, 0, 0
    for part, e in ends:
        goes_on = e["first"] == last
        first, before = (last_first, carried) if goes_on else (base, 0)
        lines.append((part, base, first, before))
        whole = e["start"] == 0
        last_first = first if whole else base + e["start"]
        carried = before + e["total"] if whole else e["total"]
        base, last = base + e["n"], e["last"]
    offsets = table.sparkSession.createDataFrame(lines, "__part long, __base long, __first long, __before long")
    found = table.join(F.broadcast(offsets), "__part")
    in_first = F.col("__run") == 0
    columns = {"i": F.col("__base") + F.col("__n"), "first": F.when(in_first, F.col("__first")).otherwise(F.col("__base") + F.col("__run"))}
    if value:
        columns["before"] = F.col("__sum") + F.when(in_first, F.col("__before")).otherwise(0)
    return found.select(*rows.columns, *[c.alias(k) for k, c in columns.items()])


def fingerprinted(conversations: DataFrame) -> DataFrame:
    """(c, p, f, len, before): each turn's place in its conversation, fingerprint, code points and those of the turns before it."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    print_ = F.expr(f"substring(unhex(sha2(concat(char_length(role), ':', role, text), 256)), 1, {PRINT})")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("c", "turn", "role", print_.alias("f"), F.char_length("text").cast("long").alias("len"))
    found = numbered(rows, ["c", "turn", "role", "f"], ["c"], "len")
    return found.select("c", (F.col("i") - F.col("first")).alias("p"), "f", "len", "before")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): heads taken from the first conversation of each family of ``FAMILY``, then own turns.

    Turns as from ``fingerprinted``; conversations are (c, n, total): turns and code points, turnless ones too.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 6
    own = turns.groupBy("c").agg(F.count("*").alias("n"), F.sum("len").alias("total"), F.sum(F.when(F.col("p") < h, F.col("len")).otherwise(0)).alias("own_head"))
    own = own.withColumns({"h": h, "base": F.expr(f"c - c % {FAMILY}")})
    heads = turns.where(f"p < 5 and c % {FAMILY} = 0").select(F.col("c").alias("base"), "p", "f", "len", "before")
    taken = own.select("c", "base", "h").join(heads, "base").where("p < h").select("c", "p", "f", "len", "before")
    lent = taken.groupBy("c").agg(F.count("*").alias("q"), F.sum("len").alias("lent"))
    known = materialize(own.join(lent, "c", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("q", "lent")}))
    slices = known.withColumn("slice", F.explode(F.expr(f"sequence(0L, (n - 1) div {SLICE})"))).drop("n", "total", "base")
    kept = turns.withColumn("slice", F.expr(f"p div {SLICE}")).join(slices, ["c", "slice"]).where("p >= h")
    kept = kept.select("c", F.expr("q + p - h").alias("p"), "f", "len", F.expr("lent + before - own_head").alias("before"))
    conversations = known.select("c", F.expr("q + greatest(n - h, 0)").alias("n"), F.expr("lent + total - own_head").alias("total"))
    return taken.unionByName(kept), conversations


def sort_keys(blocks: DataFrame, block_turns: int) -> list[DataFrame]:
    """Tables (c, b, key) of rising levels: fingerprints in blocks, then names of blocks in blocks, until one block a conversation."""
    levels = [blocks.select("c", "b", "key")]
    most = blocks.agg(F.max("b")).first()[0] or 0
    while most:
        named = numbered(levels[-1].select("key", "c", "b"), ["key", "c", "b"], ["key"])
        name = F.struct("b", F.lpad(F.hex("first"), 2 * NAME, "0").alias("name"))
        up = named.groupBy("c", F.expr(f"b div {block_turns}").alias("up")).agg(F.sort_array(F.collect_list(name)).alias("x"))
        levels.append(materialize(up.select("c", F.col("up").alias("b"), F.unhex(F.array_join("x.name", "")).alias("key"))))
        most //= block_turns
    return levels


def deepened(pairs: DataFrame, width: int, block_turns: int) -> DataFrame:
    """(i, c, n, total, c0, n0, x): x names that a pair shares, further by what (key, key0), of block x, share in parts of ``width`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, a, b in zip(*(batch.column(k).to_pylist() for k in (6, 7, 8)), strict=True):
                j, most = 0, min(len(a or b""), len(b or b"")) // width
                while j < most and a[j * width : (j + 1) * width] == b[j * width : (j + 1) * width]:
                    j += 1
                out.append(x * block_turns + j if x >= 0 else -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.int64())], names=batch.schema.names[:7])

    return pairs.select("i", "c", "n", "total", "c0", "n0", "x", "key", "key0").mapInArrow(run, "i long, c long, n long, total long, c0 long, n0 long, x long")


def lcp_array(ordered: DataFrame, levels: list[DataFrame], blocks: DataFrame, block_turns: int) -> DataFrame:
    """(i, c, n, v, k): turns shared with the conversation before (-1 for the first) and their code points."""
    earlier = ordered.select((F.col("i") + 1).alias("i"), F.col("c").alias("c0"), F.col("n").alias("n0"), F.col("key").alias("key0"))
    pairs = ordered.join(earlier, "i", "left").withColumn("x", F.when(F.col("c0").isNull(), F.lit(-1)).otherwise(0).cast("long")).withColumn("n0", F.coalesce("n0", F.lit(0)))
    pairs = deepened(pairs, NAME if len(levels) > 1 else PRINT, block_turns)
    for depth in range(len(levels) - 2, -1, -1):
        here = levels[depth].withColumnRenamed("b", "x")
        pairs = pairs.join(here, ["c", "x"], "left").join(here.select(F.col("c").alias("c0"), "x", F.col("key").alias("key0")), ["c0", "x"], "left")
        pairs = deepened(pairs, NAME if depth else PRINT, block_turns)
    pairs = pairs.withColumn("x", F.least("x", "n0"))  # one that is shared as a whole has no block x to look into
    at = pairs.withColumn("b", F.when(F.col("x") > 0, F.expr(f"x div {block_turns}")))
    at = at.join(blocks.select("c", "b", "lens", "start"), ["c", "b"], "left")
    part = F.expr(f"start + aggregate(slice(lens, 1, int(x - b * {block_turns})), 0L, (a, y) -> a + y)")
    shared = F.when(F.col("x") <= 0, F.lit(0)).when(F.col("start").isNull(), F.col("total")).otherwise(part)
    return at.select("i", "c", "n", F.col("x").alias("v"), shared.cast("long").alias("k"))


NODE, OPEN, ALIAS = 0, 1, 2
#: l, r: first and last conversation; lo, hi: depths above which and to which the node goes; rep: its first separator, parent: that of its
#: parent; least: smallest id; first_c, first_n: id and turns of conversation l. An open separator has its place in r, its value in hi, and the
#: conversation right of it, if nothing has taken that in, in tail, tail_c, tail_n. An alias leads from rep to parent.
FIELDS = ("kind", "l", "r", "lo", "hi", "rep", "parent", "children", "least", "leaves", "k", "first_c", "first_n", "tail", "tail_c", "tail_n")
ROWS = ", ".join(f"{f} long" for f in FIELDS)
FAR = 1 << 70


def nearest_smaller(elements: list[dict], final: bool) -> list[tuple]:
    """Rows of ``FIELDS`` that come of a block of separators in order, as open ones: closed nodes, open separators, aliases."""
    out: list[tuple] = []
    left: list[dict] = []
    stack: list[dict] = []
    single = None

    def node(n: dict, r: int, lo: int, parent: int) -> None:
        out.append((NODE, n["l"], r, lo, n["hi"], n["rep"], parent, n["children"], n["least"], n["leaves"], n["k"], n["first_c"], n["first_n"], None, None, None))

    def taken(into: dict, gap: dict | None) -> None:
        if gap is not None:
            into["least"] = min(into["least"], gap["least"])
            into["leaves"] += gap["leaves"]
            into["k"] += gap["k"]

    for e in elements:
        at, v, gap = e["r"], e["hi"], None
        if single is not None:
            i, c, n = single
            top = stack[-1]
            lo = max(top["hi"], v)
            gap = {"l": i, "hi": n, "rep": None, "children": 0, "least": c, "leaves": int(v < n), "k": 0, "first_c": c, "first_n": n}
            if n > lo:
                node(gap, i, lo, top["rep"] if top["hi"] >= v else e["rep"])
        while stack and stack[-1]["hi"] > v:
            top = stack.pop()
            taken(top, gap)
            if stack:
                below = stack[-1]
                node(top, at - 1, max(below["hi"], v), below["rep"] if below["hi"] >= v else e["rep"])
                gap = top
            else:  # its left end lies in an earlier block
                left.append(top)
                gap = None
        if stack and stack[-1]["hi"] == v:
            top = stack[-1]
            taken(top, gap)
            taken(top, e)
            top["children"] += e["children"]
            if e["alias"]:
                out.append((ALIAS, None, None, None, None, e["rep"], top["rep"], *[None] * 9))
        else:
            taken(e, gap)
            if gap is not None:
                e["l"], e["first_c"], e["first_n"] = gap["l"], gap["first_c"], gap["first_n"]
            stack.append(e)
        single = (e["tail"], e["tail_c"], e["tail_n"]) if e["tail"] is not None else None
        e["tail"] = None
    if not final:
        rest = left + stack
        for e in rest:
            tail = single if e is rest[-1] and single is not None else (None, None, None)
            least = e["least"] if e["least"] < FAR else None
            out.append((OPEN, e["l"], e["r"], None, e["hi"], e["rep"], None, e["children"], least, e["leaves"], e["k"], e["first_c"], e["first_n"], *tail))
    return out


def reduced(group: pa.Table, size: int | None) -> pa.Table:
    """``nearest_smaller`` of a block: (i, c, n, v, k) of the LCP array or open separators; all there is if ``size``, the number of conversations, is given."""
    names = group.column_names
    if "kind" in names:
        elements = sorted(group.select(FIELDS).to_pylist(), key=lambda e: e["r"])
        for e in elements:
            e["alias"] = True
            e["least"] = FAR if e["least"] is None else e["least"]
    else:
        rows = sorted(zip(*(group.column(x).to_pylist() for x in ("i", "c", "n", "v", "k")), strict=True))
        unknown = {"l": None, "first_c": None, "first_n": None, "least": FAR, "leaves": 0, "alias": False}
        elements = [{"r": i, "hi": v, "rep": i, "children": int(n > v), "k": k, "tail": i, "tail_c": c, "tail_n": n, **unknown} for i, c, n, v, k in rows]
    if size is not None:
        elements.append({"r": size, "hi": -1, "rep": 0, "children": 0, "k": 0, "tail": None, "tail_c": None, "tail_n": None, "l": None, "first_c": None, "first_n": None, "least": FAR, "leaves": 0, "alias": False})
    out = nearest_smaller(elements, size is not None)
    columns = zip(*out, strict=True) if out else [[] for _ in FIELDS]
    return pa.table([pa.array(list(x), pa.int64()) for x in columns], names=list(FIELDS))


def reducing(size: int | None):
    def run(group: pa.Table) -> pa.Table:
        return reduced(group, size)

    return run


def intervals(lcp: DataFrame, n: int, elements: int) -> DataFrame:
    """Nodes (``FIELDS``) of the Cartesian tree over the LCP array of ``n`` conversations, each with its parent's first separator."""
    passes, rows, left = [], lcp.withColumn("part", F.expr(f"i div {elements}")), n
    while True:
        size = n if left <= elements else None
        passes.append(materialize(rows.groupBy("part").applyInArrow(reducing(size), ROWS)))
        if size is not None:
            break
        rest = passes[-1].where(f"kind = {OPEN}")
        now = rest.count()
        if 2 * now > left:  # values fall and rise through most of a block: longer blocks get further
            elements *= 4
        left = now
        rows = numbered(rest, ["r"], ["r"]).withColumn("part", F.expr(f"i div {elements}")).drop("i", "first")
    nodes = None
    for found in passes:
        if nodes is not None:  # separators that this pass merged into earlier ones
            alias = found.where(f"kind = {ALIAS}").select(F.col("rep").alias("parent"), F.col("parent").alias("now"))
            nodes = nodes.join(alias, "parent", "left").withColumn("parent", F.coalesce("now", "parent")).select(*FIELDS)
        own = found.where(f"kind = {NODE}").select(*FIELDS)
        nodes = own if nodes is None else nodes.unionByName(own)
    return nodes


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv, the smallest id of the parent: children and slices of parents meet by position."""
    nodes = materialize(nodes)
    parents = nodes.where("rep is not null").select(F.col("rep").alias("parent"), F.col("least").alias("parent_conv"), F.explode(F.expr(f"sequence(l div {SLICE}, r div {SLICE})")).alias("slice"))
    return nodes.withColumn("slice", F.expr(f"l div {SLICE}")).join(parents, ["parent", "slice"], "left").drop("slice")


def ends(ordered: DataFrame) -> DataFrame:
    """(l, ends): SHA-256 of the ids, in order and joined by commas, of equal conversations, by the place of their first."""
    chunks = ordered.groupBy(F.col("first").alias("l"), F.expr(f"(i - first) div {CHUNK}").alias("chunk"))
    chunks = chunks.agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["l", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["l", "ends"])

    return chunks.repartition("l").sortWithinPartitions("l", "chunk").select("l", "ids").mapInArrow(run, "l long, ends string")


def expanded(nodes: DataFrame, blocks: DataFrame, block_turns: int) -> DataFrame:
    """One row for each depth of each node."""
    deep = nodes.where("hi > 0").withColumn("b", F.explode(F.expr(f"sequence(greatest(lo, 0) div {block_turns}, (hi - 1) div {block_turns})")))
    lone = deep.where("l = r")  # saves nothing, so needs no lengths
    long_ = f"hi - greatest(lo, 0) > {SLICE}"
    lone = lone.where(f"not ({long_})").unionByName(lone.where(long_).repartition("l", "b"))
    lone = lone.withColumn("x", F.explode(F.expr(f"sequence(greatest(lo, b * {block_turns}), least(hi, (b + 1) * {block_turns}) - 1)"))).withColumn("shared", F.lit(0).cast("long"))
    many = deep.where("l < r").join(blocks.select(F.col("c").alias("first_c"), "b", "lens", "start"), ["first_c", "b"])
    many = many.withColumn("x", F.explode(F.expr(f"sequence(greatest(lo, b * {block_turns}), least(hi, (b + 1) * {block_turns}) - 1)")))
    many = many.withColumn("shared", F.expr(f"start + aggregate(slice(lens, 1, int(x - b * {block_turns})), 0L, (a, y) -> a + y)")).drop("lens", "start")
    top = nodes.where("lo < 0").withColumns({"b": F.lit(0).cast("long"), "x": F.lit(-1).cast("long"), "shared": F.lit(0).cast("long")})
    rows = lone.unionByName(many).unionByName(top).withColumn("depth", F.col("x") + 1)
    full = F.col("depth") == F.col("hi")
    return rows.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("lo") + 1, F.col("parent_conv")).otherwise(F.col("least")).cast("long").alias("parent_conv_id"),
        F.expr("r - l + 1").alias("n_convs"),
        F.when(full, F.col("children") + (F.col("first_n") > F.col("hi")).cast("long")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.expr("k - (r - l) * shared").alias("saved_tokens"),
        F.when(full & (F.col("first_n") == F.col("hi")), F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS, elements: int = ELEMENTS) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    turns, known = rebuilt(fingerprinted(conversations))
    row = F.sort_array(F.collect_list(F.struct("p", "f", "len", "before"))).alias("x")
    blocks = turns.groupBy("c", F.expr(f"p div {block_turns}").alias("b")).agg(row)
    key = F.unhex(F.array_join(F.transform("x.f", F.hex), "")).alias("key")
    blocks = materialize(blocks.select("c", "b", key, F.col("x.len").alias("lens"), F.array_min("x.before").alias("start")))
    levels = sort_keys(blocks, block_turns)
    keyed = known.join(levels[-1].select("c", "key"), "c", "left").withColumn("key", F.coalesce("key", F.lit(b"")))
    ordered = numbered(keyed.select("key", "c", "n", "total"), ["key", "c"], ["key"])
    lcp = lcp_array(ordered, levels, blocks, block_turns)
    nodes = with_parents(intervals(lcp, ordered.count(), elements))
    return expanded(nodes.join(ends(ordered), "l", "left"), blocks, block_turns)


def op13_query(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``prefix_trie`` over all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
