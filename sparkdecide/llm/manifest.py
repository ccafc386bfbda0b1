"""A Merkle manifest of a table of documents: content-addressed records, proofs by descent, checks of tampering.

Each row is a leaf, the SHA-256 of its columns. In each language the leaves ascend by
doc_id, and every FAN consecutive nodes become the digest of theirs until one is left,
the language's root; these, ordered by language, become the whole root likewise. What is
stored is digest-to-children records: a digest names its children and nothing else, so equal
subtrees are one record.

A proof is made by descent. The digits of a leaf's rank (of its language first, then
of its place in it) say which child to take at each record; requests that share leading digits
are one request until they part, so that no record is looked up more than once and the root
isn't a hot key. The children that are not taken, left and right of the one that is, are a
segment of the path. Reversed, the segments fold a leaf's digest up to the root.

Ranks come from a range partitioning of the leaves and from counts of its partitions; a
language that holds most rows is spread like any other.

Defined results: a null column counts as ``-``; null languages are one language, the
first; null ids come first. Rows with one id are ordered by digest, and equal rows are leaves of
their own, with proofs of their own. An empty table gives no rows and no root. Other
columns are not read. Rows that are equal in all that is hashed are ranked in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, remove

#: Children of a node, and the bits of a digit.
FAN, BITS = 8, 3
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of values, each with its length in bytes before it; a null is ``-``."""
    told = (F.coalesce(F.concat(F.octet_length(s := v.cast("string")).cast("string"), F.lit(":"), s), F.lit("-")) for v in values)
    return F.sha2(F.concat(*told), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with rank, from 0, and n, the rows of its group; the table that it reads). Nulls come first and are a group."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the number of the partition, and 33 bits for the row's place in it
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"_{c}") for c in group), F.col("_part").alias("_p"), "_first", before.alias("_before"), F.sum("_n").over(of_group).alias("n"))
    same = part == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(starts, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"), "n"), rows


def levels_above(n: Column) -> Column:
    """How many levels stand above n nodes."""
    return F.when(n > 1, F.floor((F.length(F.bin(n - 1)) + (BITS - 1)) / BITS)).otherwise(0).cast("int")


def built(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(tables with digest, children; g, digest, depth of each group's root) over nodes g, idx, n, digest; n is the group's size."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    roots = nodes.filter("n = 1").select("g", "digest", F.lit(0).alias("depth"))
    levels: list[DataFrame] = []
    while most > 1:
        most = -(-most // FAN)
        run = nodes.filter("n > 1").groupBy("g", F.shiftright("idx", BITS).alias("idx"), F.shiftright(F.col("n") + (FAN - 1), BITS).alias("n"))
        children = run.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("children"))
        nodes = materialize(children.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{name}{len(levels)}")
        levels.append(nodes)
        roots = roots.unionByName(nodes.filter("n = 1").select("g", "digest", F.lit(len(levels)).alias("depth")))
    return levels, roots


@dataclass(frozen=True)
class Manifest:
    """leaves: the leaves' columns, g (the language's number), rank and depth (in its language).

    subroots: g, digest, depth. top: digest, depth; one row. records: digest, children.
    """

    leaves: DataFrame
    subroots: DataFrame
    top: DataFrame
    records: DataFrame
    scratch: tuple[DataFrame, ...] = ()

    def remove(self) -> None:
        """Delete its tables, once all that is made of them is written."""
        remove(*self.scratch)


def build(leaves: DataFrame) -> Manifest:
    """leaves: lang, doc_id, leaf (a digest) and any more columns, but for g, rank, n and depth."""
    placed, sorted_leaves = ranked(leaves, ["lang"], ["doc_id", "leaf"], "leaves")
    langs, sorted_langs = ranked(sorted_leaves.select("lang").distinct(), [], ["lang"], "langs")
    langs = langs.select(F.col("lang").alias("_lang"), F.col("rank").alias("g"))
    placed = placed.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang").withColumn("depth", levels_above(F.col("n")))
    placed = materialize(placed, "placed")
    remove(sorted_leaves, sorted_langs)
    levels, roots = built(placed.select("g", F.col("rank").alias("idx"), "n", F.col("leaf").alias("digest")), "level")
    subroots = materialize(roots, "subroots")
    n = F.lit(subroots.count()).cast("long")
    more, top = built(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), n.alias("n"), "digest"), "top")
    records = placed.sparkSession.createDataFrame([], "digest string, children array<string>")
    for t in (*levels, *more):
        records = records.unionByName(t.select("digest", "children"))
    return Manifest(placed.drop("n"), subroots, top.select("digest", "depth"), records.dropDuplicates(["digest"]), (placed, subroots, *levels, *more))


def _segment(children: Column, digit: Column) -> Column:
    """The children that aren't taken, joined: left and right of the one at ``digit``."""
    left, right = F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.lit(FAN))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _prefixes(requests: DataFrame, lowest: int) -> DataFrame:
    """g, height, idx: what a descent to ``lowest`` passes for requests g, rank, depth."""
    heights = requests.select("g", "rank", F.explode(F.sequence(F.least(F.lit(lowest), F.col("depth")), F.col("depth"))).alias("height"))
    return heights.select("g", "height", F.expr(f"shiftright(rank, {BITS} * height)").alias("idx")).distinct()


def _descended(frontier: DataFrame, records: DataFrame, wanted: DataFrame, steps: int, lowest: int) -> DataFrame:
    """frontier (g, height, idx, digest, path and any more) after ``steps`` digits, each row down to ``lowest`` at most."""
    rest = [c for c in frontier.columns if c not in ("g", "height", "idx", "digest", "path")]
    known = records.select(F.col("digest").alias("_digest"), "children")
    wanted = wanted.select(F.col("g").alias("_g"), F.col("height").alias("_height"), F.col("idx").alias("_idx"))
    for _ in range(steps):
        rows = frontier.join(known, (F.col("digest") == F.col("_digest")) & (F.col("height") > lowest), "left")
        down = rows.select("g", "height", "idx", "digest", "path", "children", *rest, F.posexplode(F.coalesce("children", F.array("digest"))).alias("digit", "child"))
        taken = F.col("children").isNotNull()
        frontier = down.select(
            "g", (F.col("height") - taken.cast("int")).alias("height"), F.when(taken, F.col("idx") * FAN + F.col("digit")).otherwise(F.col("idx")).alias("idx"), F.col("child").alias("digest"),
            F.when(taken, F.concat("path", F.array(_segment(F.col("children"), F.col("digit"))))).otherwise(F.col("path")).alias("path"), *rest,
        )
        frontier = frontier.join(wanted, (F.col("g") == F.col("_g")) & (F.col("height") == F.col("_height")) & (F.col("idx") == F.col("_idx")), "left_semi")
    return frontier


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """requests (g, rank, depth and any more; all leaves if None) with root, subroot and path, its segments from the leaf's run to the root."""
    requests = m.leaves if requests is None else requests
    top = m.top.select(F.lit(0).cast("long").alias("g"), F.col("depth").alias("height"), F.lit(0).cast("long").alias("idx"), "digest", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    deep = m.top.agg(F.max("depth")).first()[0] or 0
    langs = requests.select("g").distinct().select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.lit(deep).alias("depth"))
    top = _descended(top, m.records, _prefixes(langs, 0), deep, 0).select(F.col("idx").alias("g"), "path", "root")
    deep = m.subroots.agg(F.max("depth")).first()[0] or 0
    start = top.join(m.subroots, "g").select("g", F.col("depth").alias("height"), F.lit(0).cast("long").alias("idx"), "digest", "path", "root", F.col("digest").alias("subroot"))
    runs = _descended(start, m.records, _prefixes(requests, 1), max(0, deep - 1), 1)
    # the last digit beside each request: its run is looked up once for all of the run
    runs = runs.join(m.records.select(F.col("digest").alias("_digest"), "children"), (F.col("digest") == F.col("_digest")) & (F.col("height") == 1), "left")
    runs = runs.select(F.col("g").alias("_g"), F.col("idx").alias("_idx"), "children", "path", "root", "subroot")
    found = requests.join(runs, (F.col("g") == F.col("_g")) & (F.shiftright("rank", BITS) == F.col("_idx")))
    digit = F.pmod("rank", F.lit(FAN)).cast("int")
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(_segment(F.col("children"), digit))))
    return found.select(*requests.columns, "root", "subroot", F.reverse(path).alias("path"))


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest gives along its path."""
    return F.aggregate(path, digest, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, joined, from the leaf's run to the root and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
