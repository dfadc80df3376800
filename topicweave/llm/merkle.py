"""A Merkle manifest of a dataset, kept as a log of nodes in completion order.

Every row is a leaf. In each group the leaves are in order, and every ``ARITY`` consecutive
nodes of a level become a node of the next, the last run being shorter, until one is left.
The nodes of a tree are written in postorder: a node follows the last node below it. So a node's
place in the log is known without looking: it is the number of nodes that are complete before its
first leaf, plus the size of its own subtree, less one.

* *Aligned builders*: ``BLOCK`` leaves that begin at a multiple of ``BLOCK`` are whole subtrees, so a
  builder needs no other and its nodes are next to each other in the log. Their tops are the leaves of
  the next round, until a round has one builder in each group. A round makes the table ``BLOCK`` times smaller.
* *Proofs* go the other way: from the round of the root down, each builder reads its part of the log, gives the
  siblings of a leaf by their closed-form places, and puts the siblings above its top behind them.

The roots of the groups are the leaves of one more tree, whose root names the dataset.

* Null values are leaves' values like any other; the null group is first.
* Leaves with one id are in the order of their digests, so repeated rows and ties have one result.
* Long texts are hashed whole. An empty table has no rows, no log and no root.
* Other columns are not part of a leaf, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.plans.tables import materialise, with_position

ARITY = 8
#: Levels that one builder makes, and its leaves.
HEIGHT = 4
BLOCK = ARITY**HEIGHT
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "grp long, place long, level int, position long, digest string"
_PATH = "array<struct<before:string,behind:string>>"


def digest(parts: list[str]) -> str:
    """Hex SHA-256 of the digests ``parts`` one after the other, as text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(n: int) -> list[int]:
    """Nodes of each level of a tree over ``n`` leaves, leaves first."""
    found = [n]
    while found[-1] > 1:
        found.append(-(-found[-1] // ARITY))
    return found


def postorder(n: int, level: int, position: int) -> int:
    """Place in the log of the node ``position`` of ``level`` of a tree over ``n`` leaves."""
    first = position * ARITY**level
    leaves = min(ARITY**level, n - first)
    before = sum(first // ARITY**j for j in range(len(widths(n))))
    return before + sum(-(-leaves // ARITY**j) for j in range(level + 1)) - 1


def leaf(text: Column | None = None) -> Column:
    """Digest of a row's fields, each ``-`` or its size in bytes, a colon and its value."""
    def part(name: str) -> Column:
        value = F.col(name).cast("string") if name != "text" or text is None else text
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(part(name) for name in FIELDS)), 256)


def numbered(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Leaves with ``grp``, the number of their group, and ``position`` and ``n`` in it.

    One range-partitioned sort; a group's positions are global ones less those before the group.
    """
    placed = materialise(with_position(leaves, [F.asc_nulls_first(group), *(F.asc_nulls_first(c) for c in order)], "at"), "leaves")
    sizes = materialise(placed.groupBy(group).agg(F.count("*").alias("n"), F.min("at").alias("first")), "group_sizes")
    groups = materialise(with_position(sizes, [F.asc_nulls_first(group)], "grp"), "groups")
    named = groups.select(F.col(group).alias("of_group"), "grp", "n", "first")
    return (placed.join(named, F.col(group).eqNullSafe(F.col("of_group")))
            .withColumn("position", F.col("at") - F.col("first")).drop("of_group", "at", "first"))


def _build(nodes: DataFrame, round_no: int) -> DataFrame:
    """The log of one round: the nodes above ``nodes`` (``grp``, ``n``, ``position``, ``digest``) and themselves.

    ``n`` are the leaves of the group's whole tree, of which ``nodes`` are the level ``round_no * HEIGHT``.
    """
    base = round_no * HEIGHT

    def builder(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position", ignore_index=True)
        n, grp = int(part["n"].iloc[0]), int(part["grp"].iloc[0])
        levels = len(widths(n))
        level, first, row = base, int(part["position"].iloc[0]), part["digest"].tolist()
        log = []
        while True:
            log += [(grp, postorder(n, level, first + i), level, first + i, d) for i, d in enumerate(row)]
            if level == base + HEIGHT or level + 1 == levels:
                break
            row = [digest(row[i:i + ARITY]) for i in range(0, len(row), ARITY)]
            level, first = level + 1, first // ARITY
        # the top is a leaf of the next round, which writes it, unless it is the root
        kept = [entry for entry in log if entry[2] < base + HEIGHT or entry[2] + 1 == levels]
        top = [entry for entry in log if entry[2] == base + HEIGHT and entry[2] + 1 < levels]
        return pd.DataFrame([(*entry, False) for entry in sorted(kept, key=lambda e: e[1])] + [(*entry, True) for entry in top],
                            columns=["grp", "place", "level", "position", "digest", "open"])

    block = F.floor(F.col("position") / BLOCK)
    return nodes.select("grp", "n", "position", "digest", block.alias("block")).groupBy("grp", "block").applyInPandas(
        builder, f"{_NODE}, open boolean")


def build_log(leaves: DataFrame) -> list[DataFrame]:
    """The log in rounds: ``grp``, ``place``, ``level``, ``position``, ``digest``, and ``open`` for tops of the next round.

    Rounds: the logarithm of the largest group's size to the base ``BLOCK``.
    """
    sizes = leaves.select("grp", "n").distinct()
    rounds, nodes = [], leaves.select("grp", "n", "position", "digest")
    while True:
        log = materialise(_build(nodes, len(rounds)), "merkle_log")
        rounds.append(log)
        tops = log.where("open")
        if tops.isEmpty():
            return rounds
        nodes = tops.join(sizes, "grp").select("grp", "n", "position", "digest")


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``grp``, ``root`` (the node of the group that is last in its log) and ``round_no``, where that was made."""
    last = [log.where("NOT open").groupBy("grp").agg(F.max("place").alias("place"), F.max_by("digest", "place").alias("root"))
            .withColumn("round_no", F.lit(i)) for i, log in enumerate(rounds)]
    whole = reduce(DataFrame.union, last)
    return whole.groupBy("grp").agg(F.max_by("root", "place").alias("root"), F.max_by("round_no", "place").alias("round_no"))


def fold(start: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof give."""
    for before, behind in path:
        start = digest([before, start, behind])
    return start


def _extract(log: DataFrame, sizes: DataFrame, given: DataFrame, round_no: int, fold_leaves: bool) -> DataFrame:
    """Proofs of the nodes that a round began with, by ``grp`` and ``position``.

    ``given`` has rows with a ``path``, that of the builder's top, and if the leaves are to be folded one row for each
    of them with its ``position`` and the digest to ``check``.
    """
    base = round_no * HEIGHT

    def read(part: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        names = ["grp", "position", "proof_sha256", "folded_root"] if fold_leaves else ["grp", "position", "path"]
        if not len(part):
            return pd.DataFrame(columns=names)
        n, grp = int(part["n"].iloc[0]), int(part["grp"].iloc[0])
        width = widths(n)
        at = dict(zip(part["place"].tolist(), part["digest"].tolist(), strict=True))
        is_path = given["path"].notna()
        higher = [(e["before"], e["behind"]) for e in given.loc[is_path, "path"].iloc[0]]
        runs: dict[tuple[int, int], list[str]] = {}

        def path_of(i: int) -> list[tuple[str, str]]:
            path = []
            for level in range(base, min(base + HEIGHT, len(width) - 1)):
                parent, own = divmod(i, ARITY)
                if (level, parent) not in runs:
                    first = parent * ARITY
                    runs[level, parent] = [at[postorder(n, level, k)] for k in range(first, min(first + ARITY, width[level]))]
                run = runs[level, parent]
                path.append(("".join(run[:own]), "".join(run[own + 1:])))
                i = parent
            return path + higher

        out = []
        if fold_leaves:
            for position, check in zip(given.loc[~is_path, "position"].tolist(), given.loc[~is_path, "check"], strict=True):
                path = path_of(int(position))
                out.append((grp, int(position), digest([side for both in path for side in both]), fold(check, path)))
        else:
            for position in part.loc[part["level"] == base, "position"].tolist():
                out.append((grp, position, [{"before": a, "behind": b} for a, b in path_of(position)]))
        return pd.DataFrame(out, columns=names)

    block = F.floor(F.col("position") * F.pow(F.lit(float(ARITY)), F.col("level") - base) / BLOCK)
    part = log.where("NOT open").withColumn("block", block).join(sizes, "grp")
    kind = "proof_sha256 string, folded_root string" if fold_leaves else f"path {_PATH}"
    return part.groupBy("grp", "block").cogroup(given.groupBy("grp", "block")).applyInPandas(read, f"grp long, position long, {kind}")


def proofs(rounds: list[DataFrame], sizes: DataFrame, tops: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """``grp``, ``position`` and ``path`` of every leaf, read from the log alone.

    ``tops`` has the ``path`` from each group's root on (an empty one ends there) and the ``round_no`` that made the root. A
    path has an entry for each level: the run's digests before the node and behind it. With ``checked`` (``grp``,
    ``position``, ``check``) the leaves are folded where their paths are, so that no path is stored: the result then has
    ``proof_sha256``, that of all siblings level by level, and ``folded_root``.
    """
    found = None
    for round_no in reversed(range(len(rounds))):
        here = tops.where(F.col("round_no") == round_no).select("grp", F.lit(0).cast("long").alias("block"), "path")
        if found is not None:
            here = here.union(found.select("grp", F.col("position").alias("block"), "path"))
        given = here.select("grp", "block", F.lit(None).cast("long").alias("position"), "path", F.lit(None).cast("string").alias("check"))
        last = checked is not None and round_no == 0
        if last:
            given = given.union(checked.select("grp", F.floor(F.col("position") / BLOCK), "position", F.lit(None).cast(_PATH), "check"))
        found = materialise(_extract(rounds[round_no], sizes, given, round_no, last), "merkle_proofs")
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """Every row with its leaf, the root of its language and of all, and the check of a tampered copy.

    In the copy, the rows whose id has a CRC-32 that 3 divides have their text's A-Z lower-cased. A null id is
    not tampered with.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", leaf().alias("digest"), F.when(hit, leaf(lowered)).alias("altered"))
    leaves = materialise(numbered(rows, "lang", ["doc_id", "digest"]), "manifest_leaves")
    sizes = materialise(leaves.select("grp", "n").distinct(), "tree_sizes")
    rounds = build_log(leaves)
    subroots = materialise(roots(rounds), "subroots")
    top_leaves = materialise(subroots.select(F.lit(0).cast("long").alias("grp"), F.lit(sizes.count()).cast("long").alias("n"),
                                             F.col("grp").alias("position"), F.col("root").alias("digest")), "top_leaves")
    top_rounds = build_log(top_leaves)
    top = materialise(roots(top_rounds), "top_root")
    ends = top.select("grp", "round_no", F.array().cast(_PATH).alias("path"))
    upper = proofs(top_rounds, top_leaves.select("grp", "n").distinct(), ends).select(F.col("position").alias("grp"), "path")
    tops = materialise(subroots.join(upper, "grp").select("grp", "round_no", "path"), "subroot_paths")
    checked = leaves.select("grp", "position", F.coalesce("altered", "digest").alias("check"))
    found = proofs(rounds, sizes, tops, checked)
    return (leaves.join(found, ["grp", "position"]).join(subroots.select("grp", F.col("root").alias("subroot")), "grp")
            .withColumn("root", top.select("root").scalar())
            .select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def oracle_sql() -> str:
    """The manifest in SQL: levels, paths and folds by recursion, without a log."""
    def part(value: str) -> str:
        return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR)))::VARCHAR || ':' || {value}, '-')"

    columns = ["doc_id", "source", "lang", "n_chars"]
    plain = " || ".join(part(c) for c in [*columns, "text"])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tampered = " || ".join(part(c) for c in [*columns, lower])
    bit = "xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)"
    eight = "c"
    for _ in range(8):
        eight = f"list_transform([{eight}], lambda c: {bit})[1]"
    return f"""
        WITH RECURSIVE ids AS (
            SELECT DISTINCT doc_id, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                lambda crc, b: list_transform([xor(crc, b)], lambda c: {eight})[1]) AS crc
            FROM documents
        ), hit AS (
            SELECT doc_id AS hit_id, coalesce((4294967295 - crc) % 3 = 0, false) AS tampered FROM ids
        ), leaves AS (
            SELECT d.doc_id, dense_rank() OVER (ORDER BY d.lang NULLS FIRST) - 1 AS grp, sha256({plain}) AS leaf,
                   CASE WHEN tampered THEN sha256({tampered}) ELSE sha256({plain}) END AS other
            FROM documents d JOIN hit ON doc_id IS NOT DISTINCT FROM hit_id
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
        ), sub AS (
            SELECT 0 AS level, grp, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM placed
            UNION ALL
            SELECT DISTINCT level + 1, grp, pos // 8, sha256(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY grp, pos // 8
                       ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 7) // 8
            FROM sub WHERE n > 1
        ), subroots AS (
            SELECT grp, h AS subroot FROM sub WHERE n = 1
        ), top AS (
            SELECT 0 AS level, grp AS pos, subroot AS h, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT DISTINCT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY pos // 8
                       ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 7) // 8
            FROM top WHERE n > 1
        ), steps AS (
            SELECT 0 AS tree, level, grp, pos, h, n FROM sub WHERE n > 1
            UNION ALL
            SELECT 1, level, NULL, pos, h, n FROM top WHERE n > 1
        ), height AS (
            SELECT grp, max(level) AS height FROM sub GROUP BY grp
        ), runs AS (
            SELECT tree, level, grp, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM steps GROUP BY ALL
        ), walk AS (
            SELECT grp, pos AS leaf_pos, 0 AS step, other AS h, '' AS seen FROM placed
            UNION ALL
            SELECT w.grp, w.leaf_pos, w.step + 1,
                   sha256(list_aggregate(list_concat(r.hs[:own], [w.h], r.hs[own + 2:]), 'string_agg', '')),
                   w.seen || coalesce(list_aggregate(list_concat(r.hs[:own], r.hs[own + 2:]), 'string_agg', ''), '')
            FROM (
                SELECT w.*, step < height AS low, CASE WHEN step < height THEN step ELSE step - height END AS level,
                       CASE WHEN step < height THEN leaf_pos // CAST(8 ** step AS BIGINT) ELSE w.grp // CAST(8 ** (step - height) AS BIGINT) END AS at,
                       CASE WHEN step < height THEN leaf_pos // CAST(8 ** step AS BIGINT) ELSE w.grp // CAST(8 ** (step - height) AS BIGINT) END % 8 AS own
                FROM walk w JOIN height t ON w.grp = t.grp
            ) w JOIN runs r ON r.tree = CASE WHEN low THEN 0 ELSE 1 END AND r.level = w.level
                AND (NOT low OR r.grp = w.grp) AND r.run = w.at // 8
        ), ends AS (
            SELECT grp, leaf_pos, arg_max(h, step) AS folded_root, arg_max(seen, step) AS seen FROM walk GROUP BY ALL
        )
        SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(e.seen) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
        FROM placed p JOIN subroots s ON p.grp = s.grp JOIN ends e ON e.grp = p.grp AND e.leaf_pos = p.pos
             JOIN (SELECT h FROM top WHERE n = 1) t ON true
    """
