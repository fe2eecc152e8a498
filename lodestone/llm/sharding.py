"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends from the root: at each node the children draw -ln(u) / weight, u from a hash of the row's key and the child's name,
and the least draw wins, so that a child gets rows in proportion to its weight. Only the children on the way draw: with 2 regions of 3 racks of 4
shards that is 9 hashes, not 24. A shard that is added, or whose weight grows, becomes one more child of the root that leads straight to it. Its draw takes
weight / (all weights) of the rows, from everywhere alike; every other draw is what it was, so rows move into that shard only
and none between others. The tree itself is a constant in the plan, whose size doesn't change the expression.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import Scratch, let, pick, table
from lodestone.plans.values import text

#: Rows of a sorted run of slots.
RUN = 1 << 21


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0

    @property
    def leaf(self) -> str:
        return f"{self.region}/{self.rack}/{self.shard}"


@dataclass(frozen=True)
class Tree:
    """shards: those that the tree was built with. growth: shards that were added since, and what others have gained, in order."""

    shards: tuple[Shard, ...]
    growth: tuple[Shard, ...] = ()

    def grown(self, *more: Shard) -> Tree:
        """With shards added; one that is there already gains the weight."""
        return replace(self, growth=(*self.growth, *more))

    def children(self) -> dict[str, list[tuple[str, float, str]]]:
        """node -> (name, weight, the node it leads to) of its children; the root is ''."""
        nodes: dict[str, dict[str, float]] = {"": {}}
        for s in self.shards:
            above, path = "", ""
            for part in (s.region, s.rack, str(s.shard)):
                path = f"{path}/{part}" if path else part
                nodes.setdefault(above, {})
                nodes[above][path] = nodes[above].get(path, 0.0) + s.weight
                above = path
        out = {node: [(name, weight, name) for name, weight in each.items()] for node, each in nodes.items()}
        out[""] += [(f"+{i}:{s.leaf}", s.weight, s.leaf) for i, s in enumerate(self.growth)]
        return out


def tree(shards: int, regions: int = 2, racks: int = 3) -> Tree:
    """Equal shards dealt over the racks of the regions."""
    return Tree(tuple(Shard(f"region{s % regions}", f"rack{s // regions % racks}", s) for s in range(shards)))


def next_shard(shards: int, regions: int = 2, racks: int = 3) -> Shard:
    return Shard(f"region{shards % regions}", f"rack{shards // regions % racks}", shards)


DEPTH = 3


def descend(key: Column, to: Tree) -> Column:
    """struct(region, rack, shard) of the leaf that the descent ends at. A null key is as an empty one. u is of the first 52 bits of an MD5 hash."""
    child = lambda name, weight, leads: f"named_struct('name', {text(name)}, 'weight', {float(weight)!r}D, 'to', {text(leads)})"
    children = F.expr(f"map({', '.join(f'{text(node)}, array({", ".join(child(*c) for c in each)})' for node, each in to.children().items())})")

    def step(own: Column, at: Column) -> Column:
        below = F.try_element_at(children, at)
        drawn = F.transform(below, lambda c: F.struct((-F.log((F.conv(F.substring(F.md5(F.concat(own, F.lit(":"), c["name"])), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)) / c["weight"]).alias("draw"), c["to"].alias("to")))
        return F.coalesce(F.array_min(drawn)["to"], at)  # a leaf has no children

    def down(own: Column) -> Column:
        at: Column = F.lit("")
        for _ in range(DEPTH):
            at = let(at, lambda a: step(own, a))
        return let(F.split(at, "/"), lambda p: F.struct(p[0].alias("region"), p[1].alias("rack"), p[2].cast("int").alias("shard")))

    return let(F.coalesce(key.cast("string"), F.lit("")), down)


def placed(spark: SparkSession, docs: DataFrame, shards: Tree, grown: Tree) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard; a row for each row of docs.

    doc_id and the tree decide alone (law `key`). size is the text's bytes plus 8, null texts as empty. slot numbers
    the rows of a shard from 0 without gaps, by doc_id; repeated rows get slots of their own. All rows without a doc_id
    share a shard. Very long texts are measured where they stand. Other columns are ignored. No rows: no rows.
    """
    own = pick(docs, "doc_id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = own.select("doc_id", (F.octet_length("text") + 8).cast("bigint").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), descend(F.col("doc_id"), shards).alias("to"), descend(F.col("doc_id"), grown)["shard"].alias("grown_shard"), F.monotonically_increasing_id().alias("tie"))
    scratch = Scratch(spark, "shards")
    rows = scratch.write(rows.select("doc_id", "size", "text_crc32", "to.region", "to.rack", "to.shard", "grown_shard", "tie"), "rows")
    # Slots: ranges of (shard, doc_id) in sorted tasks, and the rows of the shard in the tasks before.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RUN)
    ranged = rows.repartitionByRange(n, "shard", "doc_id", "tie").sortWithinPartitions("shard", "doc_id", "tie").drop("tie")
    ranged = scratch.write(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("task", F.shiftright("at", 33))
    starts = ranged.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("shard", "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    scratch.drop("rows")
    return ranged.join(starts, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard"
    )


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: Tree) -> None:
    """docs as Parquet under path, a folder for each shard; a shard's rows are written by as many tasks as have them."""
    cols = docs.columns
    if "shard" in cols:
        raise ValueError("a column of docs is named shard, as the folders are")
    at = cols.index("doc_id")
    flat = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    flat.select("*", descend(F.col(f"c{at}"), shards)["shard"].alias("shard")).toDF(*cols, "shard").write.partitionBy("shard").parquet(path)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = placed(spark, table(spark, sf_dir, "documents"), tree(24), tree(24).grown(next_shard(24)))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def _oracle(shards: Tree, grown: Tree) -> str:
    """The same descent, level by level, and CRC-32 over each text's bytes by a table of 256 remainders."""
    values = lambda t: ", ".join(f"('{node}', '{name}', {weight!r}::double, '{to}')" for node, each in t.children().items() for name, weight, to in each)
    draw = "-ln((cast('0x' || substr(md5(key || ':' || name), 1, 13) as bigint)::double + 0.5) / 4503599627370496) / weight"

    def levels(t: str) -> str:
        out = f"{t}0 as (select doc_id, key, '' as node from d)"
        for k in range(DEPTH):
            out += f",\n{t}{k + 1} as (select doc_id, any_value(key) as key, coalesce(arg_min(c.too, {draw}), any_value({t}{k}.node)) as node from {t}{k} left join {t}c c on c.node = {t}{k}.node group by doc_id)"
        return out

    return f"""
with ac(node, name, weight, too) as (values {values(shards)}),
bc(node, name, weight, too) as (values {values(grown)}),
d as (select doc_id, coalesce(cast(doc_id as varchar), '') as key, coalesce(text, '') as text from documents),
tab as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as tab),
{levels('a')},
{levels('b')},
c as (select doc_id, strlen(text) + 8 as size, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) as crc from d, tab)
select c.doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, 'key' as law, cast(split_part(a3.node, '/', 3) as integer) as shard,
  row_number() over (partition by a3.node order by c.doc_id) - 1 as slot, cast(split_part(b3.node, '/', 3) as integer) as grown_shard, split_part(a3.node, '/', 1) as region, split_part(a3.node, '/', 2) as rack
from c join a3 on c.doc_id = a3.doc_id join b3 on c.doc_id = b3.doc_id
"""


OP10_SQL = _oracle(tree(24), tree(24).grown(next_shard(24)))
