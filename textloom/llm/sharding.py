"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import gapless, hash60, table


@dataclass(frozen=True)
class Node:
    """A leaf (``shard`` set) or an inner node; ``name`` must be unique among its siblings."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def tree(shards: int, *, racks: int = 4, per_rack: int = 5, base: int = 40) -> Node:
    """Regions of ``racks`` x ``per_rack`` shards up to ``base``; each later shard opens a region of its own.

    So the tree of n + 1 shards, n >= base, is that of n with one subtree more: every other
    weight is unchanged at every level, and rows can only move into the new subtree.
    """
    full = min(shards, base)
    regions, size = [], racks * per_rack
    for r in range(0, full, size):
        rows = []
        for k in range(r, min(r + size, full), per_rack):
            rows.append(Node(f"k{k // per_rack}", tuple(Node(f"s{s}", shard=s) for s in range(k, min(k + per_rack, full)))))
        regions.append(Node(f"r{r // size}", tuple(rows)))
    for s in range(full, shards):
        regions.append(Node(f"own{s}", (Node("k0", (Node(f"s{s}", shard=s),)),)))
    return Node("root", tuple(regions))


def draw(key: Column, path: str, weight: float) -> Column:
    """ln(u) / weight for u in (0, 1] from the MD5 of key and path; the largest draw wins.

    A child wins with probability in proportion to its weight, and a changed weight changes that
    child's draws alone.
    """
    hexed = F.substring(F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(path)).cast("binary")), 1, 13)
    u = (F.conv(hexed, 16, 10).cast("double") + 1.0) / F.lit(float(2**52))
    return F.log(u) / F.lit(float(weight))


def descend(key: Column, node: Node, path: str = "") -> Column:
    """The shard that ``key`` comes to below ``node``, as one column expression."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return descend(key, live[0], f"{path}/{live[0].name}")
    draws = F.array(*[F.struct(draw(key, f"{path}/{c.name}", c.weight).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)])
    if all(c.shard is not None for c in live):
        return F.element_at(F.array(*[F.lit(c.shard) for c in live]), F.array_max(draws)["i"] + 1)
    below = F.array(*[F.lit(i) for i in range(len(live))])
    won = F.array_max(draws)["i"]
    # transform over a one-element array evaluates the draw once and names it for the branches
    pick = lambda i: _branches(key, live, path, i)
    return F.element_at(F.transform(F.array(F.element_at(below, won + 1)), pick), 1)


def _branches(key: Column, live: list[Node], path: str, i: Column) -> Column:
    out = None
    for j, c in enumerate(live):
        value = descend(key, c, f"{path}/{c.name}")
        out = F.when(i == j, value) if out is None else out.when(i == j, value)
    return out


def shard(docs: DataFrame, *, shards: int = 40, root: Node | None = None, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Law ``key``: id and tree alone decide the shard. Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 16; slot numbers a shard's rows from 0 in
    the order of the id's MD5; grown_shard is the place in ``grown`` (default: one shard more).
    Repeated rows and equal ids share a shard and get slots of their own. A null id hashes as ''.
    No shard is ever sorted by one task, see ``gapless``. Other columns are not read.
    """
    root, grown = root or tree(shards), grown or tree(shards + 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        descend(key, root).cast("int").alias("shard"), descend(key, grown).cast("int").alias("grown_shard"), hash60(key).alias("_h"),
    )
    return gapless(rows, "shard", ["_h", "doc_id", "text_crc32"], docs.count()).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39."""
    return shard(table(spark, sf_dir, "documents"))


def _sql_descent(root: Node, name: str) -> str:
    """DuckDB SQL for a CTE: (id, name) with the shard of each id, level by level."""
    level, ctes, prev = [("", root)], [], "ids"
    for depth in range(3):
        rows = [f"('{path}', '{path}/{c.name}', {c.weight!r}, {c.shard if c.shard is not None else -1})" for path, n in level for c in n.children]
        path = f"{prev}.at" if depth else "''"
        ctes.append(
            f"{name}{depth} AS (SELECT id, max_by(c.child, (ln(((('0x' || substr(md5(id || '|' || c.child), 1, 13))::BIGINT)::DOUBLE + 1.0) / 4503599627370496.0)) / c.w) AS at, "
            f"max_by(c.shard, (ln(((('0x' || substr(md5(id || '|' || c.child), 1, 13))::BIGINT)::DOUBLE + 1.0) / 4503599627370496.0)) / c.w) AS {name} "
            f"FROM {prev} JOIN (VALUES {', '.join(rows)}) c(parent, child, w, shard) ON c.parent = {path} GROUP BY id)"
        )
        level = [(f"{path_}/{c.name}", c) for path_, n in level for c in n.children]
        prev = f"{name}{depth}"
    return ", ".join(ctes)


#: CRC-32 of each text's UTF-8 bytes: the table from its polynomial, then a fold over the bytes.
_CRC = """
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
crcs AS (
  SELECT doc_id, size, id, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents), crc_table)"""

ORACLE = f"""
WITH ids AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS id FROM documents),
{_sql_descent(tree(40), "shard")}, {_sql_descent(tree(41), "grown_shard")}, {_CRC}
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(id), 1, 15), doc_id, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM crcs JOIN shard2 USING (id) JOIN grown_shard2 USING (id)
"""
