"""A Merkle manifest of a data set: every row's leaf, the root over all of them, and a proof for each.

Leaves of a language ascend by doc_id; two consecutive nodes become the hash of both, a last one alone the hash of itself,
until one is left, the language's subroot. The subroots, by language, make the root likewise.

Bottom up, BITS levels at a time: 2**BITS consecutive nodes are a row of a persisted table, and the node that they become
is an element of a row of the next. Top down, the tables are joined the other way: a row inherits the proof above it, each
of its nodes puts its own siblings before that, and hands it to the row below. A leaf hashes its proof and folds its hash,
or the tampered one, with it. So a tree of n leaves takes log(n) / BITS joins, each of 2**BITS times fewer rows than the
one below it, and a language that holds most rows is dealt to tasks by blocks like the others.

Leaves get their places by a sort over ranges of (language, doc_id, leaf), which the counts of the ranges turn into
numbers; equal rows are spread over ranges too.

Defined cases: null values are `-`; null languages and null doc_ids come first, a null doc_id is never tampered with; rows
with one language and doc_id are ordered by their leaves, equal ones have a place each; empty texts are `0:`, texts of any
length are hashed by Spark; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Levels of a table, so that a row holds up to 2**BITS nodes.
BITS = 8
#: The columns of a leaf in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: doc_ids whose crc32 this divides are tampered with.
TAMPERED = 7
#: Of a tree's key, its number of nodes in the level and, by numbers from 0, the block and its nodes.
_BLOCK = "key string, n long, block long"


def leaf(values: dict[str, Column]) -> Column:
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(part(values[c]) for c in COLUMNS)).cast("binary"), 256)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """`rows` (key, `of`, hash, ...) with each one's place in its key, by `of` and hash, and the key's number of rows.

    The places are those of a sort by ranges, whose counts, a row for each key of each range, shift them.
    """
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    order = ["key", F.col("of").asc_nulls_first(), "hash", "tie"]
    sorted_ = spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    at = materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), name).withColumn("range", F.shiftright("at", 33))
    counts = at.groupBy("key", "range").agg(F.min("at").alias("low"), F.count("*").alias("c"))
    w = Window.partitionBy("key")
    shifted = counts.select("key", "range", (F.sum("c").over(w.orderBy("range")) - F.col("c") - F.col("low")).alias("shift"), F.sum("c").over(w).alias("n"))
    return at.join(shifted, ["key", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def _digest(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def grow(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of a block of a level of n nodes, from its nodes to the one that they become."""
    levels = [nodes]
    for _ in range(min(BITS, (n - 1).bit_length())):
        below = levels[-1]
        levels.append([_digest(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[str]], k: int) -> str:
    """Those of node k within its block, joined, level by level."""
    out = []
    for level in levels[:-1]:
        if (other := k ^ 1) < len(level):
            out.append(level[other])
        k >>= 1
    return "".join(out)


def fold(node: str, places: list[tuple[int, int]], proof: str) -> str:
    """The root that `node` and the siblings in `proof` give; `places` are (place, number of nodes) tree by tree."""
    at = 0
    for pos, n in places:
        while n > 1:
            if pos ^ 1 < n:
                other, at = proof[at : at + 64], at + 64
                node = _digest(other, node) if pos & 1 else _digest(node, other)
            else:
                node = _digest(node)
            pos, n = pos >> 1, (n + 1) >> 1
    return node


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = b.to_pydict()
        hashes = [grow([x["hash"] for x in nodes], n)[-1][0] for nodes, n in zip(c["nodes"], c["n"])]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("block"), pa.array([(n + (1 << BITS) - 1) >> BITS for n in c["n"]], pa.int64()), pa.array(hashes, pa.string())], names=["key", "pos", "n", "hash"])


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Rows of up to 2**BITS consecutive nodes."""
    node = F.struct("pos", "hash", *more)
    return nodes.groupBy("key", "n", F.shiftright("pos", BITS).alias("block")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))


def build(nodes: DataFrame, name: str, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """From (key, pos, n, hash and `more`): the persisted levels, lowest first, and the (key, hash) that each tree ends in."""
    levels = [materialize(_blocks(nodes, *more), f"{name}-level")]
    while True:
        above = levels[-1].select("key", "n", "block", F.transform("nodes", lambda x: F.struct(x["hash"].alias("hash"))).alias("nodes")).mapInArrow(_joined, "key string, pos long, n long, hash string")
        above = materialize(above, f"{name}-nodes")
        if not above.where("n > 1").limit(1).count():
            return levels, above.select("key", "hash")
        levels.append(materialize(_blocks(above), f"{name}-level"))


def _pushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = b.to_pydict()
        for i, nodes in enumerate(c["nodes"]):
            levels = grow([x["hash"] for x in nodes], c["n"][i])
            proofs = [siblings(levels, k) + c["proof"][i] for k in range(len(nodes))]
            same = lambda v, kind: pa.array([v] * len(nodes), kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(c["key"][i], pa.string()), pa.array([x["pos"] for x in nodes], pa.int64()), same(c["above"][i], pa.string()), pa.array(proofs, pa.string())], names=["key", "block", "above", "proof"])


def push(levels: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
    """The lowest level's rows with `above` and the proof that they inherit, from (key, above, proof) of the trees."""
    proofs = top.withColumn("block", F.lit(0).cast("long"))
    for k, level in reversed(list(enumerate(levels))):
        met = level.hint("merge").join(proofs, ["key", "block"])
        if k == 0:
            return met
        proofs = materialize(met.mapInArrow(_pushed, "key string, block long, above string, proof string"), f"{name}-proofs")
    raise ValueError("no level")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    plain = {c: F.col(c) for c in COLUMNS}
    changed = leaf(plain | {"n_chars": F.col("n_chars") + 1})
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    # '' is the null language; no other key is empty
    rows = docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"), F.col("doc_id").alias("of"), leaf(plain).alias("hash"), F.when(hit, changed).alias("changed"))
    leaves = numbered(materialize(rows, "merkle-leaves"), "merkle-sorted")
    levels, subroots = build(leaves, "merkle", "of", "changed")
    langs = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), "hash"), "merkle-langs")
    upper, roots = build(langs, "merkle-langs", "of")
    first = roots.first()
    root = first.hash if first else None
    lang_rows = push(upper, roots.select("key", F.col("hash").alias("above"), F.lit("").alias("proof")), "merkle-langs")

    def lang_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            for i, nodes in enumerate(c["nodes"]):
                grown = grow([x["hash"] for x in nodes], c["n"][i])
                out = [(x["of"], f"{x['hash']}:{x['pos']}:{c['n'][i]}", siblings(grown, k) + c["proof"][i]) for k, x in enumerate(nodes)]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in zip(*out)], names=["key", "above", "proof"])

    def leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            for i, nodes in enumerate(c["nodes"]):
                grown = grow([x["hash"] for x in nodes], c["n"][i])
                subroot, place, langs = c["above"][i].split(":")
                upper_place = (int(place), int(langs))
                out = []
                for k, x in enumerate(nodes):
                    proof = siblings(grown, k) + c["proof"][i]
                    folded = fold(x["changed"] or x["hash"], [(x["pos"], c["n"][i]), upper_place], proof)
                    out.append((x["of"], x["hash"], subroot, root, _digest(proof), folded, folded == root))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=NAMES)

    top = materialize(lang_rows.mapInArrow(lang_proofs, "key string, above string, proof string"), "merkle-tops")
    return push(levels, top, "merkle").mapInArrow(leaf_rows, SCHEMA)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def crc32_sql(text: str) -> str:
    """zlib's crc32 of a string as a DuckDB expression: bit by bit over its bytes."""
    bit = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(range(0, octet_length(encode({text})), 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {bit}), 4294967295)"


def oracle() -> str:
    """manifest() over `documents` as DuckDB SQL, by recursion over levels."""

    def leaf_sql(n_chars: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')" for v in (*COLUMNS[:3], n_chars, "text")) + ")"

    def tree(name: str, base: str) -> str:
        return f"""{name}(lvl, k, pos, h, n) AS ({base} UNION ALL
  SELECT lvl + 1, k, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY lvl, k, pos // 2, n)"""

    return f"""WITH RECURSIVE base AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS pos, count(*) OVER (PARTITION BY k) AS n FROM (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS k, {leaf_sql('n_chars')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % {TAMPERED} = 0 THEN {leaf_sql('(n_chars + 1)')} END AS changed FROM documents)),
{tree('t', 'SELECT 0, k, pos, leaf, n FROM base')},
s AS MATERIALIZED (SELECT k, h AS subroot, (row_number() OVER (ORDER BY k) - 1)::BIGINT AS p, count(*) OVER () AS m FROM t WHERE n = 1),
{tree('u', "SELECT 0, '', p, subroot, m FROM s")},
nodes AS MATERIALIZED (SELECT 0 AS tree, * FROM t UNION ALL SELECT 1, * FROM u),
w(id, tree, lvl, k, pos, n, p, m, h, proof) AS (SELECT id, 0, 0, base.k, pos, n, p, m, coalesce(changed, leaf), '' FROM base JOIN s USING (k) UNION ALL
  SELECT w.id, CASE WHEN w.n > 1 THEN tree ELSE 1 END, CASE WHEN w.n > 1 THEN lvl + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.k ELSE '' END, CASE WHEN w.n > 1 THEN w.pos // 2 ELSE p END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE m END, p, m,
    CASE WHEN w.n = 1 THEN w.h WHEN w.pos % 2 = 1 THEN sha256(x.h || w.h) ELSE sha256(w.h || coalesce(x.h, '')) END, proof || coalesce(x.h, '')
  FROM w LEFT JOIN (SELECT tree AS xt, lvl AS xl, k AS xk, pos AS xp, h FROM nodes) x ON xt = tree AND xl = lvl AND xk = w.k AND xp = xor(w.pos, 1) AND w.n > 1 WHERE w.n > 1 OR tree = 0)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM w JOIN base USING (id) JOIN s ON s.k = base.k WHERE tree = 1 AND w.n = 1"""
