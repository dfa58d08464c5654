"""Merkle manifest of a dataset, with a proof for every row (operator 12).

Leaves are ordered within groups; each group is a tree of arity 8, and the
groups' roots are the leaves of one more tree.  How many children a parent has
follows from its place and its level's size.

1. Leaves are digested in the scan (texts go no further) and numbered by sorted
   ranges.
2. Each range is combined as its leaves arrive: a child's digest goes to its
   partial parent; once all children are there, the parent's digest is made and
   becomes a child's in turn, up to the group's root.
3. What remains is the frontier: children of parents that more than one range
   holds parts of.  It is dealt out by ancestors ``STEP`` levels up and combined
   in the same way, until only roots are left.  A range has at most twice seven
   such children a level, so the frontier is small beside the leaves.
4. The group roots are numbered and combined likewise.
5. Reverse links: each range names the parents it couldn't complete, and those
   above them; their children, found by parent, complete the proofs of its
   leaves.

Defined results: null values are leaves' ``-``; rows alike are leaves of their
own; rows of equal order are ordered by their leaf; a null order comes first;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from judgelab.llm.common import crc_mod, discard, materialise, ranked, table

ARITY = 8
#: Levels that one dealing of the frontier climbs.
STEP = 4
RANGE_LEAVES = 32768
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree long, leaves long, level int, idx long, digest string"
_FOUND = _NODE + ", open boolean"


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the values in order, each with its length in bytes before it; ``-`` for a null."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*said).cast("binary"), 256)


class Tree:
    """Nodes of a group's tree: what arrives goes up as far as it can."""

    def __init__(self, keep: bool = False):
        self.partial: dict[tuple, dict[int, str]] = {}
        self.whole: dict[tuple, list[str]] | None = {} if keep else None  # children of completed parents

    def add(self, tree: int, leaves: int, level: int, idx: int, digest: str) -> str | None:
        """Give a node to its parent; returns the root's digest when this completes the tree."""
        size = -(-leaves // ARITY**level)
        while size > 1:
            parent = (tree, leaves, level + 1, idx // ARITY)
            kids = self.partial.setdefault(parent, {})
            kids[idx % ARITY] = digest
            if len(kids) < min(ARITY, size - parent[3] * ARITY):
                return None
            row = [kids[k] for k in range(len(kids))]
            del self.partial[parent]
            if self.whole is not None:
                self.whole[parent] = row
            digest = sha256("".join(row).encode()).hexdigest()
            level, idx, size = level + 1, parent[3], -(-size // ARITY)
        return digest

    def frontier(self) -> Iterator[tuple]:
        for (tree, leaves, level, idx), kids in self.partial.items():
            for k, digest in kids.items():
                yield tree, leaves, level - 1, idx * ARITY + k, digest


def _table(rows: list[tuple], kind: str) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names = [f.split() for f in kind.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table({n: pa.array(list(c), types[t]) for (n, t), c in zip(names, cols, strict=True)})


def _combiner(keep: bool):
    def combine(t: pa.Table) -> pa.Table:
        """The frontier (open), a root (level -1) and, with ``keep``, the children of parents completed here."""
        tree, rows = Tree(keep), []
        for node in zip(*[t[c].to_pylist() for c in ("tree", "leaves", "level", "idx", "digest")], strict=True):
            root = tree.add(*node)
            if root:
                rows.append((node[0], node[1], -1, 0, root, False))
        rows += [(*node, True) for node in tree.frontier()]
        for (no, leaves, level, idx), kids in (tree.whole or {}).items():
            rows += [(no, leaves, level - 1, idx * ARITY + k, digest, False) for k, digest in enumerate(kids)]
        return _table(rows, _FOUND)

    return combine


def _upper_nodes(ranged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (tree, digest), and all nodes (tree, level, idx, digest) that more than one range has to know of."""
    now = materialise(ranged.groupBy("part").applyInArrow(_combiner(False), _FOUND), "frontier")
    every, level = now, 0
    while True:
        open_ = now.filter("open")
        lowest = open_.agg(F.min("level")).first()[0]
        if lowest is None:
            break
        level = max(level, lowest) + STEP
        up = F.greatest(F.lit(level) - F.col("level"), F.lit(0))
        ancestor = F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), up)).cast("long")
        now = materialise(open_.groupBy("tree", F.greatest("level", F.lit(level)).alias("up"), ancestor.alias("at")).applyInArrow(_combiner(True), _FOUND), "frontier")
        every = every.unionByName(now)
    return every.filter("level = -1").select("tree", "digest"), every.filter("level >= 0").select("tree", "level", "idx", "digest").distinct()


_PROOF = "array<struct<before:string,after:string>>"


def _needs(t: pa.Table) -> pa.Table:
    """Parents that a range can't complete by itself, and all above them: (part, tree, level, idx)."""
    part, tree, asked = t["part"][0].as_py(), Tree(), set()
    for node in zip(*[t[c].to_pylist() for c in ("tree", "leaves", "level", "idx", "digest")], strict=True):
        tree.add(*node)
    for no, leaves, level, idx in tree.partial:
        while (no, level, idx) not in asked:
            asked.add((no, level, idx))
            if -(-leaves // ARITY**level) == 1:
                break
            level, idx = level + 1, idx // ARITY
    return _table([(part, *a) for a in sorted(asked)], "part long, tree long, level int, idx long")


def _prover(schema: pa.Schema):
    def prove(key: tuple, t: pa.Table, known: pa.Table) -> pa.Table:
        tree = Tree(keep=True)
        rows = list(zip(*[t[c].to_pylist() for c in ("tree", "leaves", "level", "idx", "digest")], strict=True))
        for node in rows:
            tree.add(*node)
        children = {(no, level, idx): kids for (no, _, level, idx), kids in tree.whole.items()}
        children |= {(no, level, idx): kids for no, level, idx, kids in zip(*[known[c].to_pylist() for c in ("tree", "level", "idx", "kids")], strict=True)}
        proofs, path, last = [], [], None
        for no, leaves, _, idx, _ in rows:
            if (no, idx // ARITY) != last:  # all above the parent is the same for its children
                last, path = (no, idx // ARITY), []
                level, at, size = 1, idx // ARITY, -(-leaves // ARITY)
                while size > 1:
                    kids, k = children[no, level + 1, at // ARITY], at % ARITY
                    path.append({"before": "".join(kids[:k]), "after": "".join(kids[k + 1 :])})
                    level, at, size = level + 1, at // ARITY, -(-size // ARITY)
            kids, k = children[no, 1, idx // ARITY] if leaves > 1 else [""], idx % ARITY
            own = [{"before": "".join(kids[:k]), "after": "".join(kids[k + 1 :])}] if leaves > 1 else []
            proofs.append(own + path)
        out = t.append_column("proof", pa.array(proofs, schema.field("proof").type))
        return out.select(schema.names).cast(schema)

    return prove


def _proved(ranged: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Roots, and ``keep`` columns of the leaves with tree and proof.  ``ranged``: a written table of leaves with part."""
    node = [c.split()[0] for c in _NODE.split(", ")]
    roots, upper = _upper_nodes(ranged.select("part", *node))
    families = upper.groupBy("tree", (F.col("level") + 1).alias("level"), F.floor(F.col("idx") / ARITY).cast("long").alias("idx")).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("i"), "digest"))).alias("kids"))
    needs = ranged.select("part", *node).groupBy("part").applyInArrow(_needs, "part long, tree long, level int, idx long")
    known = needs.join(families.select("tree", "level", "idx", F.col("kids.digest").alias("kids")), ["tree", "level", "idx"])
    names = [*keep, "tree"]
    fields = ranged.select(*names)
    schema = to_arrow_schema(fields.withColumn("proof", F.lit(None).cast(_PROOF)).schema)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema) + f", proof {_PROOF}"
    return roots, ranged.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_prover(schema), ddl)


def manifest(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", range_leaves: int = RANGE_LEAVES) -> DataFrame:
    """All columns of ``leaves`` and subroot, root and proof: for each level, from below, the digests before and after.

    ``leaf`` is the row's digest.  The columns subroot, root and proof are
    replaced where the input has them.
    """
    names = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    own = [f"__c{k}" for k in range(len(names))]
    g = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("__group")  # a null group comes first
    rows = leaves.select(g, F.col(f"`{order}`").alias("__order"), F.col(f"`{leaf}`").alias("digest"), *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)], F.monotonically_increasing_id().alias("__u"))
    rows = materialise(rows, "leaves")
    groups = materialise(rows.groupBy("__group").agg(F.count("*").alias("leaves")), "groups")
    groups = materialise(ranked(groups, [], ["__group"], range_leaves).select("__group", "leaves", F.col("__at").alias("tree"), F.col("__part").alias("gpart")), "groups-numbered")
    n_groups = groups.count()
    at = ranked(rows, ["__group"], ["__order", "digest", "__u"], range_leaves).join(groups, "__group")
    at = at.select(F.col("__part").alias("part"), "tree", "leaves", F.lit(0).alias("level"), F.col("__at").alias("idx"), "digest", *own)
    # Within a range in order, so that few parents are open at a time.
    at = materialise(at.repartition("part").sortWithinPartitions("part", "tree", "idx"), "leaves-numbered")
    roots, proved = _proved(at, own)
    tops = groups.join(roots, "tree").select(F.col("gpart").alias("part"), F.lit(-1).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("leaves"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "digest", F.col("tree").alias("of"), F.col("digest").alias("subroot"))
    tops = materialise(tops.repartition("part").sortWithinPartitions("part", "idx"), "group-roots")
    root, lifted = _proved(tops, ["of", "subroot"])
    only = root.first()  # one row, or none
    lifted = lifted.select(F.col("of").alias("tree"), "subroot", F.lit(only and only["digest"]).alias("root"), F.col("proof").alias("above"))
    out = proved.join(materialise(lifted, "group-proofs"), "tree")
    discard(rows)
    return out.select(*[F.col(o).alias(c) for c, o in zip(names, own, strict=True)], "subroot", "root", F.concat("proof", "above").alias("proof"))


def folded(leaf: Column | str, proof: Column | str = "proof") -> Column:
    """The root that a leaf and a proof give."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(proof, leaf, lambda d, level: F.sha2(F.concat(level["before"], d, level["after"]).cast("binary"), 256))


def proof_digest(proof: Column | str = "proof") -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "").cast("binary"), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) == 0), F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "lang", leaf_digest(fields).alias("leaf"), leaf_digest([*fields[:-1], text]).alias("tampered"))
    out = manifest(leaves, "lang", "doc_id").withColumn("folded_root", folded("tampered"))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
