"""Merkle manifest of a dataset: a hash tree per group of rows, and a tree over the groups' roots.

Levels are built bottom-up and stored as node rows that name their parent. A recursive query then
climbs from every row's (perhaps tampered) leaf: each step joins the node above, appends the
siblings to the result as a row of that step, and folds the hash; an ordered aggregation makes a
row's proof of its steps.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwheel.llm.common import ascii_lower, materialize, table
from cartwheel.operators.joins import bounded_broadcast

FANOUT = 8
LOCAL_LEVELS = 4     # nodes above so many levels are repeated for each of the blocks below them
BLOCK = FANOUT ** LOCAL_LEVELS
TOP = -1             # the tree over the groups' roots, as a group number
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3     # where this divides crc32(doc_id), the check sees another text


def leaf_hash(row: DataFrame, columns=COLUMNS, **replaced: Column) -> Column:
    """Lowercase hex sha256 of the values: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    parts = []
    for c in columns:
        value = replaced.get(c, row[f"`{c}`"]).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ranked(rows: DataFrame, group: str | None, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx`` (0-based place in its ``group`` by ``order``) and ``n`` (its group's rows).

    A range shuffle puts the rows in order over all tasks; the places are each task's start,
    counted from one row per task and group, plus the place in the task. No group, however
    large, is in one task. Nulls come first. ``order`` must tell the rows apart.
    """
    spark = rows.sparkSession
    keys = [group] if group else []
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), name)  # task number << 33 | place
    task = F.shiftright("at", 33)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # a row per task
    starts = placed.groupBy(task.alias("task"), *keys).agg(F.min("at").alias("low"), F.count("*").alias("m"))
    starts = starts.select("task", *[F.col(k).alias("of") for k in keys], "low", F.sum("m").over(whole).alias("n"),
                           (F.sum("m").over(whole.orderBy("task")) - F.col("m")).alias("before"))
    same = [task == F.col("task"), *[F.col(k).eqNullSafe(F.col("of")) for k in keys]]
    out = placed.join(bounded_broadcast(starts), same)
    return out.select(*(f"`{c}`" for c in rows.columns), (F.col("before") + F.col("at") - F.col("low")).alias("idx"), "n")


def _build(nodes: DataFrame) -> tuple[DataFrame | None, DataFrame, int]:
    """(inner nodes, roots, levels) of the trees over ``nodes`` (grp, idx, n, digest).

    An inner node is (grp, level, run, kids): the digests (binary, concatenated) of its children,
    which are nodes run * FANOUT, ... of that level. Roots are (grp, digest). Digests are binary;
    what is hashed is their hex text.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    built, level = [], 0
    roots = nodes.where("n = 1").select("grp", "digest")
    while most > 1:
        runs = (nodes.where("n > 1").groupBy("grp", "n", F.expr(f"idx DIV {FANOUT}").alias("run"))
                .agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids")))
        text = F.lower(F.array_join(F.transform("kids", lambda k: F.hex(k["digest"])), ""))
        runs = runs.select("grp", "run", F.expr(f"(n + {FANOUT - 1}) DIV {FANOUT}").alias("n"), text.alias("text"))
        runs = materialize(runs.select("grp", F.lit(level).alias("level"), "run", "n", F.unhex("text").alias("kids"),
                                       F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "level")
        built.append(runs)
        nodes = runs.select("grp", F.col("run").alias("idx"), "n", "digest")
        roots = roots.unionAll(nodes.where("n = 1").select("grp", "digest"))
        most, level = -(-most // FANOUT), level + 1
    inner = None
    for runs in built:
        inner = runs if inner is None else inner.unionAll(runs)
    return inner, roots, level


@dataclass(frozen=True)
class Manifest:
    """A built manifest; digests are binary. Every table but the few rows joined to the leaves is
    stored in the shared folder."""

    leaves: DataFrame    # row, key (the order column), leaf, other (the leaf to check, null if the same), grp, idx, n
    nodes: DataFrame     # grp, level, run, block, kids, up_grp, up_level, up_idx
    subroots: DataFrame  # grp, of (the group's value), digest
    root: str | None     # in hex; None for an empty table
    order: str


def build(docs: DataFrame, *, columns=COLUMNS, group: str = "lang", order: str = "doc_id",
          tampered: tuple[Column, dict[str, Column]] | None = None) -> Manifest:
    """The manifest of ``docs``: leaves of ``columns``, a tree per value of ``group`` by ``order``.

    Rows of equal ``order`` are ordered by leaf; null is a group and a value of its own and comes
    first. Extra columns are ignored. ``tampered`` gives (condition, replaced columns) of the rows
    whose ``other`` leaf differs from the stored one.
    """
    leaf = leaf_hash(docs, columns)
    other = F.when(tampered[0], leaf_hash(docs, columns, **tampered[1])) if tampered else F.lit(None).cast("string")
    leaves = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{order}`").alias("key"),
                         F.col(f"`{group}`").alias("value"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("other"))
    leaves = ranked(materialize(leaves, "leaves"), "value", ["key", "leaf", "row"], "ordered")
    groups = ranked(leaves.where("idx = 0").select("value"), None, ["value"], "groups")
    groups = materialize(groups.select(F.col("value").alias("of"), F.col("idx").alias("grp"), F.col("n").alias("groups")), "numbered")
    leaves = leaves.join(bounded_broadcast(groups.select("of", "grp")), F.col("value").eqNullSafe(F.col("of"))).drop("of", "value")

    inner, subroots, levels = _build(leaves.select("grp", "idx", "n", F.col("leaf").alias("digest")))
    subroots = materialize(groups.join(subroots, "grp"), "subroots")
    tops, roots, top_levels = _build(subroots.select(F.lit(TOP).cast("long").alias("grp"), F.col("grp").alias("idx"),
                                                     F.col("groups").alias("n"), "digest"))
    root = roots.select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, _linked(leaves, inner, levels, tops, top_levels), subroots.select("grp", "of", "digest"), root and root[0], order)


def _block() -> Column:
    """What tells a leaf's block from others; equal numbers of two blocks would do no harm."""
    return F.xxhash64("grp", F.expr(f"idx DIV {BLOCK}"))


def _linked(leaves: DataFrame, inner: DataFrame | None, levels: int, tops: DataFrame | None, top_levels: int) -> DataFrame:
    """The node rows to climb: each names the node above, and which block of leaves it serves.

    Low nodes serve their own few leaves (block 0). A node with more than BLOCK leaves below it
    stands once for each block of them, so that no node row is joined to more than BLOCK leaves.
    """
    spark = leaves.sparkSession
    schema = "grp long, level int, run long, block long, kids binary, up_grp long, up_level int, up_idx long"
    parts = []
    if inner is not None:  # what stands over the last node of a group is that group's leaf of the top tree
        last = F.col("n") == 1
        up = [F.when(last, TOP).otherwise(F.col("grp")).cast("long").alias("up_grp"),
              F.when(last, 0).otherwise(F.col("level") + 1).alias("up_level"),
              F.when(last, F.col("grp")).otherwise(F.col("run")).alias("up_idx")]
        low = inner.where(F.col("level") < LOCAL_LEVELS)
        parts.append(low.select("grp", "level", "run", F.lit(0).cast("long").alias("block"), "kids", *up))
        high = inner.where(F.col("level") >= LOCAL_LEVELS).select("grp", "level", "run", "kids", *up)
    if tops is not None:
        last = F.col("n") == 1
        top = tops.select("grp", "level", "run", "kids", F.when(~last, TOP).cast("long").alias("up_grp"),
                          F.when(~last, F.col("level") + 1).alias("up_level"), F.when(~last, F.col("run")).alias("up_idx"))
        high = high.unionAll(top) if inner is not None else top
    elif inner is None:
        return spark.createDataFrame([], schema)
    blocks = leaves.groupBy(_block().alias("block"), F.col("grp").alias("of"), F.expr(f"idx DIV {BLOCK}").alias("at"), "n").count()
    own = [F.when(F.col("n") > FANOUT ** k, F.struct(F.col("of").alias("grp"), F.lit(k).alias("level"),
                                                     F.expr(f"at DIV {FANOUT ** (k + 1 - LOCAL_LEVELS)}").alias("run")))
           for k in range(LOCAL_LEVELS, levels)]
    over = [F.struct(F.lit(TOP).cast("long").alias("grp"), F.lit(k).alias("level"), F.expr(f"of DIV {FANOUT ** (k + 1)}").alias("run"))
            for k in range(top_levels)]
    if own or over:
        wanted = blocks.select("block", F.explode(F.array_compact(F.array(*own, *over))).alias("k")).select("block", "k.*").distinct()
        parts.append(high.join(wanted, ["grp", "level", "run"]).select("grp", "level", "run", "block", "kids", "up_grp", "up_level", "up_idx"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return materialize(out, "nodes")


@contextmanager
def _unlimited_recursion(spark: SparkSession):
    """Spark ends a recursive query at a million rows unless told otherwise."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


CLIMB = f"""
WITH RECURSIVE climb(row, block, grp, level, idx, step, folded, siblings) AS (
  SELECT row, block, grp, level, idx, 0, folded, CAST(NULL AS BINARY) FROM {{leaves}}
  UNION ALL
  SELECT row, c.block, up_grp, up_level, up_idx, step + 1,
         unhex(sha2(CAST(lower(hex(concat(substring(kids, 1, 32 * CAST(idx % {FANOUT} AS INT)), folded,
                                          substring(kids, 32 * CAST(idx % {FANOUT} AS INT) + 33)))) AS BINARY), 256)),
         concat(substring(kids, 1, 32 * CAST(idx % {FANOUT} AS INT)), substring(kids, 32 * CAST(idx % {FANOUT} AS INT) + 33))
  FROM climb c JOIN {{nodes}} n
    ON n.grp = c.grp AND n.level = c.level AND n.run = c.idx DIV {FANOUT}
   AND n.block = CASE WHEN c.grp >= 0 AND c.level < {LOCAL_LEVELS} THEN 0 ELSE c.block END
)
SELECT row, step, folded, siblings FROM climb
"""


def proofs(manifest: Manifest) -> DataFrame:
    """row, proof_sha256, folded_root of every leaf: the hash of its siblings' digests, from the
    leaf's run up to the root, and the root that its ``other`` leaf and these siblings give."""
    spark = manifest.leaves.sparkSession
    alone = F.col("n") == 1  # its leaf is its group's root
    start = manifest.leaves.select(
        "row", _block().alias("block"), F.when(alone, TOP).otherwise(F.col("grp")).cast("long").alias("grp"), F.lit(0).alias("level"),
        F.when(alone, F.col("grp")).otherwise(F.col("idx")).alias("idx"), F.coalesce("other", "leaf").alias("folded"))
    with _unlimited_recursion(spark):
        steps = spark.sql(CLIMB.format(leaves="{leaves}", nodes="{nodes}"), leaves=start, nodes=manifest.nodes)
        done = steps.groupBy("row").agg(F.max_by("folded", "step").alias("folded"),
                                        F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("steps"))
        text = F.array_join(F.transform("steps", lambda s: F.lower(F.hex(s["siblings"]))), "")
        return materialize(done.select("row", F.sha2(text.cast("binary"), 256).alias("proof_sha256"),
                                       F.lower(F.hex("folded")).alias("folded_root")), "proofs")


def verify(manifest: Manifest) -> DataFrame:
    """The order column, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Empty without rows. A table of one row is its own root, with an empty proof.
    """
    rows = manifest.leaves.select("row", F.col("key").alias(manifest.order), F.lower(F.hex("leaf")).alias("leaf"), "grp")
    subroots = bounded_broadcast(manifest.subroots.select("grp", F.lower(F.hex("digest")).alias("subroot")))
    root = F.lit(manifest.root).cast("string")
    return (rows.join(proofs(manifest), "row").join(subroots, "grp")
            .select(f"`{manifest.order}`", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                    (F.col("folded_root") == root).alias("verified")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by lang, checked against texts with A-Z lower-cased in every
    third document by crc32 (a null doc_id is not among them)."""
    docs = table(spark, sf_dir, "documents")
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))
    return verify(build(docs, tampered=(third, {"text": ascii_lower(docs["text"])})))


OP13_SQL = r"""
WITH RECURSIVE
field AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
         -- crc32 bit by bit: a byte is taken in, then eight shifts (-1) follow
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: list_concat([unicode(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END),
           4294967295) % 3 = 0 AS third,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS other
  FROM documents),
leaf AS MATERIALIZED (
  SELECT r, doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx,
         count(*) OVER (PARTITION BY g) AS n, leaf, other
  FROM (SELECT r, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, sha256(head || body) AS leaf,
               sha256(head || CASE WHEN third THEN other ELSE body END) AS other FROM field)),
low(g, level, idx, n, digest) AS (
  SELECT g, 0, idx, n, leaf FROM leaf
  UNION ALL
  SELECT g, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1
  GROUP BY g, level, idx // 8, n),
sub AS MATERIALIZED (SELECT g, digest, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, idx, n, digest) AS (
  SELECT 0, g, n, digest FROM sub
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1
  GROUP BY level, idx // 8, n),
node AS MATERIALIZED (SELECT g, level, idx, n, digest FROM low UNION ALL SELECT -1, level, idx, n, digest FROM high),
around AS MATERIALIZED (  -- of each node that has one above: its siblings to the left and to the right
  SELECT a.g, a.level, a.idx, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM node a JOIN node b ON a.g = b.g AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL),
climb(r, own, g, level, idx, folded, proof) AS (
  SELECT r, g, CASE WHEN n = 1 THEN -1 ELSE g END, 0, CASE WHEN n = 1 THEN g ELSE idx END, other, '' FROM leaf
  UNION ALL
  SELECT r, own, CASE WHEN a.n <= 8 AND a.g >= 0 THEN -1 ELSE a.g END, CASE WHEN a.n <= 8 AND a.g >= 0 THEN 0 ELSE a.level + 1 END,
         CASE WHEN a.n <= 8 AND a.g >= 0 THEN a.g ELSE a.idx // 8 END, sha256(before || folded || after), proof || before || after
  FROM climb c JOIN around a ON c.g = a.g AND c.level = a.level AND c.idx = a.idx)
SELECT doc_id, leaf, sub.digest AS subroot, high.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = high.digest AS verified
FROM climb JOIN leaf USING (r) JOIN sub ON sub.g = leaf.g JOIN high ON high.n = 1
WHERE climb.g = -1 AND climb.level = high.level
"""

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLE_SQL = {"op13_merkle_manifest": OP13_SQL}
