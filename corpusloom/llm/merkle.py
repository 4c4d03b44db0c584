"""Merkle manifest of a dataset: one root over all rows, and for each row the proof that it is under that root.

A row's leaf is the SHA-256 of its columns, each as its byte count and value. Leaves form one tree for each language, in the order of
their ids, and the trees' roots form one tree in the order of the languages. A parent takes ``arity`` consecutive nodes, the last of a
level those that are left; from the size of a level every node knows how many children its parent waits for.

Trees are built by combining: a task holds partial parents, each with the child digests that it has seen by their places. When a parent
has all its children it is emitted and becomes a child itself, up to whatever its task can complete. What stays open, at most two nodes a level
where leaves lie in order, is shuffled to blocks of ``arity ** HEIGHT`` times more leaves, until the roots are left. Any order and
dealing of the rows gives the same trees. Proofs go the other way: every block of ``HEIGHT`` levels gets the proof of its topmost node and hands one to
each of its lowest nodes, which are the topmost of the blocks below.

Only leaves travel, never texts. A block has ``arity ** HEIGHT`` leaves at most, whatever the size of a language. Sizes and roots of all
languages are tables as well.

Null in a column: ``-`` in the leaf. Null language: a tree of its own, first. Null doc_id: first in its tree, not tampered with. Repeated
ids: by leaf digest, equal rows side by side. Empty texts have a byte count of 0; very long texts are hashed whole. An empty table has no rows and no
root. Further columns are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, numbered, rows

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block.
HEIGHT = 12
_NODE = "tree string, n long, level int, idx long, digest string"


def leaf(values: dict[str, Column]) -> Column:
    """Digest of a row: the columns' byte counts and values, joined."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in values.values()]), 256)


def _size(n: int, level: int, arity: int) -> int:
    """Nodes of a level of a tree of ``n`` leaves."""
    return -(-n // arity**level)


def _combine(batches, arity: int):
    """Nodes to (node, made, open): parents made here, and nodes whose parents could not be."""
    from hashlib import sha256

    partial: dict[tuple, dict[int, str]] = {}
    for tree, n, level, idx, digest in rows(batches, "tree", "n", "level", "idx", "digest", size=4096):
        while True:
            size = _size(n, level, arity)
            if size == 1:  # a root
                yield tree, n, level, idx, digest, False, True
                break
            parent = idx // arity
            waits = min(arity, size - parent * arity)
            children = partial.setdefault((tree, n, level, parent), {})
            children[idx] = digest
            if len(children) < waits:
                break
            del partial[tree, n, level, parent]
            digest = sha256("".join(children[i] for i in sorted(children)).encode()).hexdigest()
            level, idx = level + 1, parent
            yield tree, n, level, idx, digest, True, False
    for (tree, n, level, _), children in partial.items():
        for idx, digest in children.items():
            yield tree, n, level, idx, digest, False, True


def build(leaves: DataFrame, arity: int = 2, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(roots, parents) of ``leaves(tree, n, idx, digest)``: ``(tree, n, level, idx, digest)`` each; ``n`` leaves of a tree have ``idx`` from 0."""
    nodes = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")
    parents, reach = None, 0
    while True:
        done = materialise(map_rows(nodes, lambda batches: _combine(batches, arity), f"{_NODE}, made boolean, open boolean"), "nodes")
        made = done.where("made").select("tree", "n", "level", "idx", "digest")
        parents = made if parents is None else parents.unionByName(made)
        left = done.where("open").drop("made", "open")
        if left.where(f"level < {_levels(arity)}").isEmpty():
            return left, parents
        reach += height
        nodes = left.repartition("tree", F.when(F.col("level") < reach, _block(reach, arity)).otherwise(F.col("idx")))


def _powers(arity: int) -> list[int]:
    out = [1]
    while out[-1] * arity < 2**62:
        out.append(out[-1] * arity)
    return out


def _levels(arity: int) -> str:
    """SQL: how many levels of parents ``n`` leaves have."""
    return "size(filter(array(" + ", ".join(f"{p}L" for p in _powers(arity)) + "), p -> p < n))"


def _block(level: int, arity: int) -> Column:
    """Place of the ancestor at ``level``, at least a node's own."""
    return F.expr(f"idx div element_at(array({', '.join(f'{p}L' for p in _powers(arity))}), {level} - level + 1)")


def prove(leaves: DataFrame, parents: DataFrame, above: DataFrame, arity: int = 2, height: int = HEIGHT) -> DataFrame:
    """``leaves`` with ``proof``: from the leaf's level up, ``left siblings|right siblings/`` for each level, then what ``above(tree, n, proof)`` says of its root."""
    import pyarrow as pa

    payload = [f for f in leaves.schema.fields if f.name not in ("tree", "n", "idx", "digest")]
    extra = pa.schema([])
    from pyspark.sql.pandas.types import to_arrow_type

    for f in payload:
        extra = extra.append(pa.field(f.name, to_arrow_type(f.dataType)))
    kinds = ", ".join(["tree string, n long, idx long, digest string, proof string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in payload]])

    def block(table):
        level, idx, digest, n = (table.column(c).to_pylist() for c in ("level", "idx", "digest", "n"))
        top = max(level)
        known = {(lv, i): d for lv, i, d in zip(level, idx, digest, strict=True) if d is not None}
        base, heads = min(level), [p for p in table.column("proof").to_pylist() if p is not None]
        if not heads or not known:
            return table.slice(0, 0).select(["tree", "n", "idx", "digest", "proof", *extra.names])
        proofs, sizes = {(top, i): heads[0] for lv, i in zip(level, idx, strict=True) if lv == top}, {lv: _size(n[0], lv, arity) for lv in range(base, top + 1)}

        def proof(lv: int, i: int) -> str:
            if (lv, i) not in proofs:
                first = i // arity * arity
                run = range(first, min(first + arity, sizes[lv]))
                own = "".join(known[lv, j] for j in run if j < i) + "|" + "".join(known[lv, j] for j in run if j > i) + "/"
                proofs[lv, i] = own + proof(lv + 1, i // arity)
            return proofs[lv, i]

        low = [at for at, lv in enumerate(level) if lv == base and digest[at] is not None]
        out = table.take(low).select(["tree", "n", "idx", "digest", *extra.names])
        return out.add_column(4, "proof", pa.array([proof(base, idx[at]) for at in low], pa.string()))

    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in payload]
    every = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest", F.lit(None).cast("string").alias("proof"), *[f.name for f in payload]).unionByName(
        parents.select("tree", "n", "level", "idx", "digest", F.lit(None).cast("string").alias("proof"), *none)
    )
    above = above.select("tree", "n", "proof", F.expr(_levels(arity)).alias("_levels"))
    most = above.agg(F.max("_levels")).first()[0] or 0
    heads = None
    for s in range(max(0, (most - 1) // height), -1, -1):
        # trees whose topmost block is in this layer begin here
        own = F.greatest(F.floor((F.col("_levels") - 1) / height), F.lit(0)) == s
        fresh = above.where(own).select("tree", "n", F.least("_levels", F.lit((s + 1) * height)).alias("level"), F.lit(0).cast("long").alias("idx"), "proof")
        heads = fresh if heads is None else heads.unionByName(fresh)
        heads = heads.select("tree", "n", "level", "idx", F.lit(None).cast("string").alias("digest"), "proof", *none)
        here = every.where(F.col("level").between(s * height, (s + 1) * height - 1)).unionByName(heads)
        got = here.withColumn("block", _block((s + 1) * height, arity)).groupBy("tree", "block").applyInArrow(block, kinds)
        heads = materialise(got, "proofs").select("tree", "n", F.lit(s * height).alias("level"), "idx", "proof") if s else None
    return got


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.filter(F.split(proof, "/"), lambda s: s != ""), digest, lambda acc, s: F.sha2(F.replace(s, F.lit("|"), acc), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, level by level."""
    return F.sha2(F.translate(proof, "|/", ""), 256)


def manifest(docs: DataFrame, arity: int = 2, height: int = HEIGHT, tampered: dict[str, Column] | None = None) -> DataFrame:
    """Each row's ``doc_id, leaf, changed, subroot, root, proof``; ``changed`` is the leaf with the columns ``tampered`` in place of its own, else the leaf."""
    own = {c: F.col(c) for c in COLUMNS}
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), leaf(own).alias("digest"),
        leaf(own | (tampered or {})).alias("changed"),
    )
    leaves = numbered(materialise(thin, "leaves"), "tree", ["doc_id", "digest"], "leaves")
    roots, parents = build(leaves, arity, height)
    roots = materialise(roots.select(F.col("tree").alias("of"), F.col("n").alias("leaves"), "digest"), "roots")
    # the languages' roots are the leaves of one more tree
    tops = numbered(roots.withColumn("tree", F.lit("")), "tree", ["of"], "tops")
    crown, joints = build(tops, arity, height)
    crown = materialise(crown, "crown")
    over = materialise(prove(tops, joints, crown.select("tree", "n", F.lit("").alias("proof")), arity, height), "over")
    root = crown.select(F.col("digest").alias("root"))
    each = over.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"))
    proved = prove(leaves.select("tree", "n", "idx", "digest", "doc_id", "changed"), parents, over.select(F.col("of").alias("tree"), F.col("leaves").alias("n"), "proof"), arity, height)
    # one row at most
    return proved.join(each, "tree").join(F.broadcast(root)).select("doc_id", F.col("digest").alias("leaf"), "changed", "subroot", "root", "proof")


def query(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, and what they say of rows whose n_chars was raised by one where 7 divides the id's checksum."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = manifest(docs, tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    folded = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("changed"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """WITH RECURSIVE sums AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc FROM documents),
parts AS (SELECT doc_id, coalesce('=' || lang, '') AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n_chars,
    CASE WHEN crc % 7 = 0 THEN coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') ELSE coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') END AS changed,
    coalesce(strlen(text) || ':' || text, '-') AS text FROM sums),
leaves AS (SELECT doc_id, tree, sha256(head || n_chars || text) AS leaf, sha256(head || changed || text) AS changed,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, sha256(head || n_chars || text)) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM parts),
nodes AS (SELECT tree, 0 AS level, idx, leaf AS digest, n FROM leaves
  UNION ALL SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, idx, subroot AS digest, n FROM subroots
  UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, idx // 2, n),
paths AS (SELECT row_number() OVER () AS row, doc_id, tree, leaf, 0 AS level, idx, n, '' AS proof, changed AS folded FROM leaves
  UNION ALL SELECT row, doc_id, p.tree, leaf, p.level + 1, p.idx // 2, (p.n + 1) // 2, proof || coalesce(digest, ''), sha256(CASE WHEN p.idx % 2 = 0 THEN folded || coalesce(digest, '') ELSE digest || folded END)
  FROM paths AS p LEFT JOIN nodes AS s ON s.tree = p.tree AND s.level = p.level AND s.idx = xor(p.idx, 1) WHERE p.n > 1),
crowns AS (SELECT row, doc_id, leaf, subroot, 0 AS level, s.idx, s.n, proof, folded FROM paths AS p JOIN subroots AS s USING (tree) WHERE p.n = 1
  UNION ALL SELECT row, doc_id, leaf, subroot, p.level + 1, p.idx // 2, (p.n + 1) // 2, proof || coalesce(digest, ''), sha256(CASE WHEN p.idx % 2 = 0 THEN folded || coalesce(digest, '') ELSE digest || folded END)
  FROM crowns AS p LEFT JOIN tops AS s ON s.level = p.level AND s.idx = xor(p.idx, 1) WHERE p.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM crowns, (SELECT digest AS root FROM tops WHERE n = 1) WHERE n = 1"""
