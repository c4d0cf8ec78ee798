"""Merkle manifest of a dataset: a tree per source, a tree over the sources, proofs per row.

Leaves of a tree are numbered in order, and every node carries the interval ``[low, high)`` of
leaf numbers that it covers. Intervals answer what a proof needs: a node is an ancestor of a
leaf if its interval contains the leaf's, and the siblings of a node are what remains of its
parent's interval when its own is taken out. Containment is not searched: a level's nodes stand
in buckets of a fixed width, so a leaf's number names the one node of the level that can
contain it. ``BAND`` levels are looked up inside one row (a block of at most 3 ** 6 nodes);
bands of levels meet by equality joins on tree and bucket, checked by the intervals. So a tree
of any height takes one narrow shuffle per six levels, and a source that holds most rows is
spread over its blocks. Texts are hashed where they are read and never move.

Everything is SQL functions; only the largest height, one number, comes to the driver.

Results in special cases:

* Null fields count as ``-``. Null doc_ids come first in their source and are not tampered
  with; the null source is the first tree.
* Ties of doc_id are ordered by the leaf's digest; repeated rows are leaves of their own, next
  to each other, with equal leaves and proofs of their own.
* A source with one row: its leaf is its subroot; a single source: its subroot is the root. A
  proof without siblings is the hash of the empty string.
* Texts of any length and empty ones are fields like others; an empty table gives no rows.
* Columns other than the five fields are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import bind
from lectern.operators.scans import global_offsets
from lectern.session import reliable_checkpoint

FANOUT, BAND = 3, 6
BLOCK = FANOUT**BAND
_HIGHEST = 39  # 3 ** 39 still fits 64 bits
_NODE = "struct<low:bigint,high:bigint,digest:string>"
_STEPS = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(counted, F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """Hash of the fields, each with its length in bytes, so that no two rows run together."""
    return F.sha2(F.concat(*[_field(value) for value in fields]), 256)


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the least h with 3 ** h >= n."""
    powers = F.array(*[F.lit(FANOUT**h) for h in range(_HIGHEST + 1)])
    return F.size(F.filter(powers, lambda power: power < n))


def _digests(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda node: node["digest"]), "")


def _levels(nodes: Column, count: Column) -> Column:
    """The block's own nodes, then ``count`` levels above them, each in order."""

    def above(level):
        last = F.ceil(F.size(level) / FANOUT).cast("int") - 1

        def parent(i):
            return bind(
                F.slice(level, i * FANOUT + 1, FANOUT),
                lambda run: F.struct(
                    F.element_at(run, 1)["low"].alias("low"),
                    F.element_at(run, -1)["high"].alias("high"),
                    F.sha2(_digests(run), 256).alias("digest"),
                ).cast(_NODE),
            )

        return F.transform(F.sequence(F.lit(0), last), parent)

    steps = F.slice(F.sequence(F.lit(1), F.lit(BAND)), F.lit(1), count)
    return F.aggregate(
        steps,
        F.array(nodes),
        lambda levels, _: bind(levels, lambda own: F.array_append(own, above(F.element_at(own, -1)))),
    )


def _local_path(levels: Column, node: Column, place: Column) -> Column:
    """Siblings of a node and of its ancestors inside the block, level by level.

    ``place`` is the node's place in its block, which names the bucket on every level.
    """

    def step(level, parents, width):
        bucket = F.floor(place / width).cast("int")

        def around(parent):
            near = F.slice(level, bucket * FANOUT + 1, FANOUT)
            inside = lambda x: (x["low"] >= parent["low"]) & (x["high"] <= parent["high"])
            return F.struct(
                _digests(F.filter(near, lambda x: inside(x) & (x["high"] <= node["low"]))).alias("left"),
                _digests(F.filter(near, lambda x: inside(x) & (x["low"] >= node["high"]))).alias("right"),
            )

        return bind(F.get(parents, bucket), around)

    numbers = F.slice(F.sequence(F.lit(0), F.lit(BAND - 1)), F.lit(1), F.size(levels) - 1)
    widths = F.array(*[F.lit(FANOUT ** (h + 1)) for h in range(BAND)])
    return F.transform(
        numbers, lambda h: step(F.get(levels, h), F.get(levels, h + 1), F.get(widths, h))
    ).cast(_STEPS)


def _blocks(nodes: DataFrame, band: int) -> DataFrame:
    """Nodes ``tree, n, number, low, high, digest, about`` in blocks, with the levels above them."""
    member = F.struct("number", F.struct("low", "high", "digest").cast(_NODE).alias("node"), "about")
    grouped = nodes.groupBy("tree", "n", F.floor(F.col("number") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(member)).alias("members")
    )
    count = F.least(F.lit(BAND), _height(F.col("n")) - band * BAND)
    own = F.transform("members", lambda m: m["node"])
    return grouped.withColumn("levels", _levels(own, count))


def _tops(blocks: DataFrame) -> DataFrame:
    """The one node that is left of each block, as a node of the next band."""
    top = F.element_at(F.element_at("levels", -1), 1)
    return blocks.select(
        "tree", "n", F.col("block").alias("number"), top["low"].alias("low"), top["high"].alias("high"),
        top["digest"].alias("digest"), F.lit(None).cast("string").alias("about"),
    )


def _members_with_paths(blocks: DataFrame) -> DataFrame:
    """Every node of the blocks with its path: the block's part, then ``path`` of the block."""
    place = lambda m: m["number"] % BLOCK
    each = F.explode(
        F.transform(
            "members",
            lambda m: F.struct(
                m["number"].alias("number"), m["node"].alias("node"), m["about"].alias("about"),
                F.concat(_local_path(F.col("levels"), m["node"], place(m)), F.col("path")).alias("path"),
            ),
        )
    )
    return blocks.select("tree", each.alias("m")).select("tree", "m.*")


def merkle_paths(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tree, root)`` of every tree and ``tree, number, node, about, path`` of every leaf.

    ``leaves`` has ``tree`` (long), ``n`` (its number of leaves), ``number`` (from 0 in the tree),
    ``digest`` and ``about``, which is handed through. A path holds, level by level, the joined
    digests of the siblings to the ``left`` and to the ``right``.
    """
    highest = leaves.select(F.max("n")).first()[0] or 0
    labelled = leaves.select("*", F.col("number").alias("low"), (F.col("number") + 1).alias("high"))
    bands, nodes = [], labelled
    while not bands or FANOUT ** (BAND * len(bands)) < highest:
        bands.append(reliable_checkpoint(_blocks(nodes, len(bands))))
        rises = _height(F.col("n")) > BAND * len(bands)
        nodes = _tops(bands[-1]).filter(rises)
    finished = [
        _tops(blocks).filter(F.greatest(_height(F.col("n")), F.lit(1)).between(BAND * b + 1, BAND * (b + 1)))
        for b, blocks in enumerate(bands)
    ]
    roots = reduce(DataFrame.unionByName, finished).select("tree", F.col("digest").alias("root"))
    empty = F.array().cast(_STEPS)
    known = bands[-1].withColumn("path", empty)
    for blocks in reversed(bands[:-1]):
        above = _members_with_paths(known).select(
            F.col("tree").alias("__tree"), F.col("number").alias("__bucket"),
            F.col("node.low").alias("__low"), F.col("node.high").alias("__high"), "path",
        )
        low = F.element_at("members", 1)["node"]["low"]
        high = F.element_at("members", -1)["node"]["high"]
        contained = (
            (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__bucket"))
            & (F.col("__low") <= low) & (high <= F.col("__high"))
        )
        known = blocks.join(above, contained, "left").withColumn("path", F.coalesce("path", empty))
    return roots, _members_with_paths(known)


def _numbered(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Rows with their tree (the place of its first row), its size and their number in it."""
    placed = global_offsets(rows, order, {"__at": F.lit(1)})
    if not by:
        whole = placed.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("tree"), "n")
        return placed.withColumn("tree", F.lit(0).cast("long")).join(whole, "tree").withColumn("number", F.col("__at"))
    trees = placed.groupBy(*by).agg(F.min("__at").alias("tree"), F.count("*").alias("n"))
    renamed = trees.withColumnsRenamed({name: f"__{name}" for name in by})
    same = [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in by]
    return placed.join(renamed, same).withColumn("number", F.col("__at") - F.col("tree"))


def dataset_proofs(documents: DataFrame, seen: Column | None = None) -> DataFrame:
    """``doc_id, leaf, seen_leaf, subroot, root, path`` of every row.

    ``path`` leads from the leaf through the subroot to the root. ``seen`` is the text as it is
    found at a later time (the text itself by default); ``seen_leaf`` is its leaf.
    """
    own = documents.select(*FIELDS, (F.col("text") if seen is None else seen).alias("__seen"))
    whole = leaf_digest([F.col(c) for c in FIELDS])
    found = leaf_digest([F.col("__seen") if c == "text" else F.col(c) for c in FIELDS])
    same = F.col("__seen").eqNullSafe(F.col("text"))
    leaves = own.select(
        F.col("source").cast("string").alias("source"), "doc_id", whole.alias("digest"),
        F.when(~same, found).alias("seen_leaf"),
    )
    numbered = _numbered(leaves, ["source", "doc_id", "digest", "seen_leaf"], ["source"])
    about = F.struct("doc_id", "seen_leaf").alias("about")
    ready = reliable_checkpoint(numbered.select("tree", "n", "number", "digest", about))
    subroots, paths = merkle_paths(ready)
    # Trees are numbered in the order of their sources.
    tops = _numbered(subroots.select(F.col("tree").alias("about"), F.col("root").alias("digest")), ["about", "digest"], [])
    roots, upper = merkle_paths(tops.select("tree", "n", "number", "digest", "about"))
    above = upper.join(roots, "tree").select(
        F.col("about").alias("tree"), F.col("node.digest").alias("subroot"), "root", F.col("path").alias("__upper")
    )
    return paths.join(above, "tree").select(
        "about.doc_id",
        F.col("node.digest").alias("leaf"),
        F.coalesce("about.seen_leaf", "node.digest").alias("seen_leaf"),
        "subroot",
        "root",
        F.concat("path", "__upper").alias("path"),
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(
        path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256)
    )


def manifest_table(documents: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document.

    Texts of documents whose decimal doc_id has an even CRC-32 lose their line feeds before
    they are checked against the manifest.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    seen = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    shown = dataset_proofs(documents, seen).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.col("seen_leaf"), F.col("path")).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit, for an engine without such a function."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    bit = "xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda a, b: {byte}), 4294967295)"


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _sql_tree(name: str, start: str) -> str:
    """All nodes of trees from ``tree, lvl, pos, n, h`` rows, and their siblings' digests."""
    return f"""
{name} AS (
  SELECT * FROM ({start})
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}
  WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
{name}_around AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.pos)"""


ORACLE = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS seen
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM doc),
{_sql_tree("node", "SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM placed")},
{_sql_tree("top", "SELECT 0 AS tree, 0 AS lvl, tree AS pos, count(*) OVER () AS n, h FROM node WHERE n = 1")},
folded AS (
  SELECT p.doc_id, p.tree, p.leaf, 0 AS lvl, p.pos, p.seen AS h, '' AS proof, p.pos AS first FROM placed p
  UNION ALL
  SELECT f.doc_id, f.tree, f.leaf, f.lvl + 1, f.pos // 3, sha256(a.l || f.h || a.r), f.proof || a.l || a.r, f.first
  FROM folded f JOIN node_around a ON a.tree = f.tree AND a.lvl = f.lvl AND a.pos = f.pos),
low AS (SELECT * FROM folded QUALIFY lvl = max(lvl) OVER (PARTITION BY tree, first)),
risen AS (
  SELECT doc_id, tree, leaf, 0 AS lvl, tree AS pos, h, proof, first FROM low
  UNION ALL
  SELECT f.doc_id, f.tree, f.leaf, f.lvl + 1, f.pos // 3, sha256(a.l || f.h || a.r), f.proof || a.l || a.r, f.first
  FROM risen f JOIN top_around a ON a.lvl = f.lvl AND a.pos = f.pos),
high AS (SELECT * FROM risen QUALIFY lvl = max(lvl) OVER (PARTITION BY tree, first))
SELECT f.doc_id, f.leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM high f JOIN node s ON s.tree = f.tree AND s.n = 1 JOIN top t ON t.n = 1"""
