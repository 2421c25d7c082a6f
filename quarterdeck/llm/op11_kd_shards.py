"""Sharding by a k-d tree over metadata: nodes are split at weighted medians along their widest dimension until leaves hold the target bytes.

A coordinate is a 64-bit integer: integral and date columns as they are, fractional ones by an order-preserving map, any other column by the hash
of its text (equal values stay together). A null is the least coordinate. A node that is to become n shards is cut so that its left side
weighs as near as possible to floor(n / 2) / n of it. The widest dimension is the one whose range is the largest share of that of all rows; ties go
to the first one named. Places on a dimension are ordered by (coordinate, hash of the text, row), so a cut never depends on ties.

Medians are found by weighted histograms: every pass sums the weights of all nodes' candidate ranges in some 2,048 bins each, and the
range shrinks to the bin that holds the median, then goes on to the next part of the place. Only bins and cuts come to the driver, whose number is bounded by
the number of shards. The tree is applied by one broadcast join per level, on tables of at most as many rows as there are shards.

Groups: rows of equal text share the place of the group's first row (least place), so no cut parts them. A group heavier than both the
heaviest row and a 32nd of a shard, or with more rows than both 1,000 and a 512th of all, is dealt row by row, as shards of near equal size come first.

Defined results: a null text counts 0 bytes, and every row one byte more than its text, so rows without text are dealt too; repeated rows are rows of
their own; an empty table gives no rows; columns of the input named like a result are replaced, other ones are kept.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import discard, staged

BIN_BITS = 11
LEAST = -(1 << 63)
_CUT = "node long, dim int, c long, h long, r long, left long, right long"


class Cut(NamedTuple):
    """Places below (c, h, r) on a dimension, itself included, go left. Children at or above `Tree.base` are shards."""

    node: int
    dim: int
    c: int
    h: int
    r: int
    left: int
    right: int


class Tree(NamedTuple):
    """Cuts by level. A child's number is that of a node, or of a shard as -1 - shard."""

    levels: list[list[Cut]]


def coordinate(df: DataFrame, name: str) -> Column:
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        made = value.cast("long")
    elif isinstance(kind, T.DateType):
        made = F.unix_date(value).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        made = F.unix_micros(value.cast("timestamp"))
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        made = F.round(value.cast("double") * 1e6).cast("long")
    else:
        made = F.xxhash64(value.cast("string"))
    return F.coalesce(made, F.lit(LEAST))


def placed(docs: DataFrame, dimensions: list[str], text: str, shards: int, keep_text: bool = False) -> DataFrame:
    """The rows with _w (size), _place (coordinates), _h and _r (-1 in a group that stays whole), and _row and _node (0, the root), written once."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.array(*[coordinate(docs, d) for d in dimensions]) if dimensions else F.array(F.lit(0).cast("long"))
    # Two texts of one hash would only be taken for a group, which changes where they go but loses nothing.
    rows = docs.select("*", (F.octet_length(value).cast("long") + 1).alias("_w"), own.alias("_place"), F.xxhash64(F.crc32(value.cast("binary")), value).alias("_h"),
                       F.monotonically_increasing_id().alias("_row"))
    rows = staged(rows if keep_text else rows.drop(text), "op11-rows")
    total = rows.agg(F.sum("_w").alias("bytes"), F.count("*").alias("n"), F.max("_w").alias("most")).first()
    groups = rows.groupBy("_h").agg(F.sum("_w").alias("bytes"), F.count("*").alias("n"), F.min("_place").alias("_first")).filter("n > 1")
    groups = staged(groups, "op11-groups")
    heavy = (F.col("bytes") > max((total["bytes"] or 0) // (32 * shards), total["most"] or 0)) | (F.col("n") > max(1000, total["n"] // 512))
    # At most 32 groups a shard weigh that much, and at most 512 have so many rows.
    dealt = F.broadcast(groups.filter(heavy).select("_h"))
    whole = rows.join(dealt, "_h", "left_anti").join(groups.filter(~heavy).select("_h", "_first"), "_h", "left")
    whole = whole.withColumn("_r", F.when(F.col("_first").isNull(), F.col("_row")).otherwise(-1)).withColumn("_place", F.coalesce("_first", "_place")).drop("_first")
    made = staged(whole.unionByName(rows.join(dealt, "_h", "left_semi").withColumn("_r", F.col("_row"))).withColumn("_node", F.lit(0).cast("long")), "op11-placed")
    discard(rows)
    discard(groups)
    return made


def noded(rows: DataFrame, tree: Tree) -> DataFrame:
    """Moves _node from the root to where the tree leads."""
    spark = rows.sparkSession
    out = rows
    for cuts in tree.levels:
        table = F.broadcast(spark.createDataFrame(cuts, _CUT))
        out = out.join(table, F.col("_node") == F.col("node"), "left")
        c = F.element_at("_place", F.col("dim") + 1)
        below = (c < F.col("c")) | ((c == F.col("c")) & ((F.col("_h") < F.col("h")) | ((F.col("_h") == F.col("h")) & (F.col("_r") <= F.col("r")))))
        out = out.withColumn("_node", F.when(F.col("node").isNull(), F.col("_node")).when(below, F.col("left")).otherwise(F.col("right"))).drop("node", "dim", "c", "h", "r", "left", "right")
    return out


def medians(rows: DataFrame, wanted: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
    """The place (c, h, r) at which each node's weight reaches the wanted one most nearly. wanted: node -> (dimension, weight)."""
    spark = rows.sparkSession
    # The state of a node: parts of the place already fixed, range of the next part, weight still to reach, weight below the range.
    state = {n: {"dim": d, "fixed": [], "lo": LEAST, "hi": (1 << 63) - 1, "left": w} for n, (d, w) in wanted.items()}
    done: dict[int, tuple[int, int, int]] = {}
    while state:
        table = [(n, s["dim"], len(s["fixed"]), *(s["fixed"] + [0, 0])[:2], s["lo"], s["hi"], max(0, (s["hi"] - s["lo"]).bit_length() - BIN_BITS)) for n, s in state.items()]
        asked = F.broadcast(spark.createDataFrame(table, "node long, dim int, depth int, f0 long, f1 long, lo long, hi long, bits int"))
        parts = F.array(F.element_at("_place", F.col("dim") + 1), F.col("_h"), F.col("_r"))
        held = rows.join(asked, F.col("_node") == F.col("node")).withColumn("_p", parts)
        held = held.filter(((F.col("depth") < 1) | (F.col("_p")[0] == F.col("f0"))) & ((F.col("depth") < 2) | (F.col("_p")[1] == F.col("f1"))))
        value = F.element_at("_p", F.col("depth") + 1)
        held = held.withColumn("_v", value).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        bins = held.groupBy("node", F.expr("shiftright(_v, bits)").alias("bin")).agg(F.sum("_w").alias("w"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
        by_node: dict[int, list] = {}
        for b in bins:
            by_node.setdefault(b["node"], []).append(b)
        for node, found in by_node.items():
            s = state[node]
            found.sort(key=lambda b: b["bin"])
            for k, b in enumerate(found):
                if b["w"] >= s["left"] or k == len(found) - 1:
                    break
                s["left"] -= b["w"]
            if b["lo"] < b["hi"]:
                s["lo"], s["hi"] = b["lo"], b["hi"]
                continue
            s["fixed"].append(b["lo"])
            s["lo"], s["hi"] = LEAST, (1 << 63) - 1
            if len(s["fixed"]) == 3:
                # The last place is taken if that comes nearer to the wanted weight than leaving it.
                over, under = b["w"] - s["left"], s["left"]
                c, h, r = s["fixed"]
                done[node] = (c, h, r if over <= under else r - 1)
                del state[node]
    return done


def grow(rows: DataFrame, dimensions: int, shards: int) -> Tree:
    """Cuts for the rows of `placed`, level by level over all nodes at once."""
    tree, leaves, numbers = Tree([]), {0: (0, shards)}, 1
    spans: list[float] | None = None
    while any(n > 1 for _, n in leaves.values()):
        here = noded(rows.select("_w", "_place", "_h", "_r", "_node"), tree)
        coords = [F.element_at("_place", d + 1) for d in range(dimensions)]
        ends = [f(c).alias(f"{name}{d}") for d, c in enumerate(coords) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        sizes = {r["_node"]: r for r in here.groupBy("_node").agg(F.sum("_w").alias("w"), *ends).collect()}
        if spans is None:
            spans = [max(1.0, float(sizes[0][f"hi{d}"]) - float(sizes[0][f"lo{d}"])) for d in range(dimensions)] if sizes else []
        wanted, cuts = {}, []
        for node, (first, n) in leaves.items():
            if n > 1 and node in sizes:
                at = sizes[node]
                widest = max(range(dimensions), key=lambda d: ((float(at[f"hi{d}"]) - float(at[f"lo{d}"])) / spans[d], -d))
                wanted[node] = (widest, max(1, round(at["w"] * (n // 2) / n)))
        places = medians(here, wanted)
        following = {}
        for node, (first, n) in leaves.items():
            if n == 1:
                continue
            place = places.get(node, (LEAST, LEAST, LEAST))
            children = []
            for start, share in ((first, n // 2), (first + n // 2, n - n // 2)):
                number = numbers if share > 1 else -1 - start
                numbers += share > 1
                if share > 1:
                    following[number] = (start, share)
                children.append(number)
            cuts.append(Cut(node, wanted.get(node, (0, 0))[0], *place, *children))
        tree.levels.append(cuts)
        leaves = following
    return tree


def assign(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), text: str = "text",
           keep_text: bool = False, slot_rows: int = 50_000) -> DataFrame:
    """The rows with size, shard and slot (gapless from 0 in each shard). Give `shards`, or target_bytes for as many shards as hold that much each.
    Texts are left out unless keep_text is set."""
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot") and (keep_text or c != text)]
    name = {c: f"in{k}" for k, c in enumerate(docs.columns)}
    plain = docs.toDF(*name.values())
    if target_bytes is not None:
        bytes_ = F.coalesce(F.octet_length(name[text]), F.lit(0)).cast("long") + 1
        shards = max(1, -(-(plain.agg(F.sum(bytes_)).first()[0] or 0) // target_bytes))
    dims = [name[d] for d in dimensions if d in name]
    rows = placed(plain, dims, name[text], shards, keep_text)
    held = noded(rows, grow(rows, max(1, len(dims)), shards))
    held = staged(held.select(*[F.col(name[c]) for c in kept], "_row", F.col("_w").alias("size"), F.greatest(-1 - F.col("_node"), F.lit(0)).cast("int").alias("shard")), "op11-held")
    discard(rows)
    # Slots: rows are numbered in pieces of a shard, and pieces start where the ones before them end.
    pieces = -(-max(1, held.count()) // (shards * slot_rows))
    held = held.withColumn("_piece", F.pmod(F.xxhash64("_row"), F.lit(pieces)))
    counts = held.groupBy("shard", "_piece").agg(F.count("*").alias("_n"))
    starts = counts.select("shard", "_piece", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_piece")) - F.col("_n")).alias("_from"))
    number = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_row"))
    slots = held.join(starts, ["shard", "_piece"]).withColumn("slot", F.col("_from") + number - 1)
    return slots.select(*[F.col(name[c]).alias(c) for c in kept], "size", "shard", "slot")


def write_shards(assigned: DataFrame, folder: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    assigned.repartition("shard", F.floor(F.col("slot") / 200_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
