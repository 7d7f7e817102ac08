"""Hard negatives of anchors by a distributed nearest-neighbour join over Voronoi cells.

Vectors are whole numbers, so scores (inner products) are exact. With one more entry, ``sqrt(M^2 - |x|^2)`` for the candidates and 0 for
the anchors, where ``M`` is the largest norm, the highest inner product is the least distance. Pivots divide the space into cells; an
anchor group is the anchors nearest to one pivot. From the candidates' distances to the pivots, and the groups' radii, follow
bounds on where a candidate can be of use: it is sent to these groups only, and compared with their anchors there.

1. Positives: groups by label and cell. The least distances of each label's cells bound how far an anchor's best rows can be.
2. Negatives: groups by cell. The positives' scores give each anchor a band of scores, that is, a shell of distances; a group takes the
   candidates that are within the hull of its shells.

Groups whose bounds exclude nothing (in many dimensions, without clusters, all of them) become one, ``OPEN``, so that a candidate is sent once for them
and not once for each. A group of many anchors or candidates is dealt in blocks of both, each a task's work, whose best rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import small_batches, staged
from paceline.llm.whitening import EXACT, finite, whole_numbers

SCALE = 256
#: Pivots, at most: rows with the smallest hash of their id.
PIVOTS = 16
#: Anchors and candidates of a group that one task compares, about.
ANCHORS, CANDIDATES = 1 << 15, 1 << 13
#: The group of all cells that need every candidate.
OPEN = -1
#: Scores computed at once.
ROWS, COLS = 512, 4096
#: Part by which bounds of distances are widened, so that rounding never excludes a row.
SLACK = 1e-9
#: The band of a negative's score, in percent of the positive's.
LOW, HIGH = 50, 95

PAIR = "anchor_id long, other_id long, score long"


def vectors(df: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id``, ``label``, ``norm`` (squared), ``v`` (32-bit entries) of the usable rows; of rows with one id the one with the least label, then vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = whole_numbers(b.column(2), scale)
                norm = (x.astype(np.float64) ** 2).sum(axis=1)
                if norm.max() >= EXACT or np.abs(x).max(initial=0) >= 1 << 31:
                    raise ValueError("a vector is too long for exact scores")
                small = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(norm.astype(np.int64)), small], ["id", "label", "norm", "v"])

    rows = df.where(finite(df[vec_col])).select(df[id_col].cast("long").alias("id"), label.cast("long").alias("label"), df[vec_col].alias("vec"))
    made = rows.where("id IS NOT NULL AND label IS NOT NULL").mapInArrow(run, "id long, label long, norm long, v binary")
    return made.groupBy("id").agg(F.min(F.struct("label", "norm", "v")).alias("r")).select("id", "r.label", "r.norm", "r.v")


def matrix(column) -> np.ndarray:
    """Rows of 32-bit entries as doubles."""
    data = [x.as_py() if hasattr(x, "as_py") else x for x in column]
    return np.frombuffer(b"".join(data), "<i4").reshape(len(data), -1).astype(np.float64)


class Pivots:
    """Pivot vectors with their further entry; distances of rows to all of them."""

    def __init__(self, rows: list, longest: int):
        x = matrix([bytes(r.v) for r in rows])
        self.longest = longest
        self.x, self.own = x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        norm = (x * x).sum(axis=1, keepdims=True)
        further = np.zeros((len(x), 1)) if anchors else np.sqrt(np.maximum(self.longest - norm, 0))
        flat = norm - 2 * x @ self.x.T + (self.x * self.x).sum(axis=1)
        return np.sqrt(np.maximum(flat, 0) + (further - self.own) ** 2)


def placed(rows: DataFrame, pivots, anchors: bool, keep: list[str]) -> DataFrame:
    """``keep`` of each row, its nearest pivot as ``cell``, its distances to all pivots as ``far``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = pivots.value.distances(matrix(b.column(b.num_columns - 1)), anchors)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))
                cell = pa.array(d.argmin(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], cell, lists], [*keep, "cell", "far"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, F.col("v").alias("_v")).mapInArrow(run, f"{kinds}, cell int, far array<double>")


def best(anchors: DataFrame, others: DataFrame, by: list[str], run, schema: str) -> DataFrame:
    """``run`` over the anchors and candidates of each group, block by block."""
    anchors, others = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (anchors, others))  # both sides may stem from one table
    return anchors.groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(run, schema)


def top(pairs: DataFrame, by: list[str], least: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= least)


def scores_in(left: np.ndarray, right: np.ndarray, most: float) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Exact scores of blocks; in 32 bits where no partial sum can pass their whole numbers."""
    kind = np.float32 if most < 1 << 24 else np.float64
    left, right = left.astype(kind), right.astype(kind)
    for j in range(0, len(right), COLS):
        for i in range(0, len(left), ROWS):
            yield slice(i, i + ROWS), slice(j, j + COLS), left[i : i + ROWS] @ right[j : j + COLS].T


def blocks(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")


def part_of(n: Column) -> Column:
    """The block of ``n`` that a row falls in by its id."""
    return F.pmod(F.xxhash64("id"), n).cast("int")


def spread(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def spans(table: DataFrame, pivots) -> DataFrame:
    """Of each label the number of candidates, and the least and greatest distance of any of them to each pivot."""
    far = [F.col("far")[k] for k in range(len(pivots.value.x))]
    own = placed(table, pivots, False, ["label"])
    return staged(own.groupBy("label").agg(F.count("*").alias("n_label"), F.array(*map(F.min, far)).alias("least"), F.array(*map(F.max, far)).alias("most")))


def positives(table: DataFrame, span: DataFrame, is_anchor: Column, pivots, longest: int, most: int) -> DataFrame:
    """``anchor_id, other_id, score, rank``: each anchor's first ``most`` other rows of its label."""
    anchors = placed(table.where(is_anchor), pivots, True, ["id", "label", "v"])
    own = placed(table, pivots, False, ["id", "label"])
    # of each label and cell the least distances to the pivot; a group's own radius, and the way to the cell, bound what its anchors find there
    order = Window.partitionBy("label", "cell").orderBy("d", "id")
    least = own.select("id", "label", "cell", F.col("far")[F.col("cell")].alias("d")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most + 1)
    least = least.groupBy("label", F.col("cell").alias("there")).agg(F.sort_array(F.collect_list("d")).alias("ds"))
    groups = anchors.groupBy("label", "cell").agg(F.max(F.col("far")[F.col("cell")]).alias("radius"), F.count("*").alias("n"))
    between = pivots.value.distances(pivots.value.x, False)  # pivots are candidates
    between = F.array(*(F.array(*map(F.lit, map(float, r))) for r in between))
    way = F.col("radius") + between[F.col("cell")][F.col("there")]
    bound = groups.join(least, "label").select("label", "cell", "radius", "n", F.transform("ds", lambda d: d + way).alias("ds"))
    bound = bound.groupBy("label", "cell", "radius", "n").agg(F.sort_array(F.flatten(F.collect_list("ds"))).alias("ds"))
    # an anchor is among the rows of its own label, hence one more; fewer rows than that: all are needed
    reach = F.when(F.size("ds") > most, F.element_at("ds", most + 1)).otherwise(F.lit(float("inf")))
    limit = (F.col("radius") + reach) * (1 + SLACK)
    bound = bound.withColumn("limit", limit).join(span, "label").withColumn("group", F.when(F.col("limit") >= F.col("most")[F.col("cell")], OPEN).otherwise(F.col("cell")))
    bound = staged(bound.select("label", "cell", "group", "limit", "n", "n_label"))
    groups = bound.groupBy("label", "group").agg(F.max("limit").alias("limit"), blocks(F.sum("n"), ANCHORS).alias("n_part"), blocks(F.max("n_label"), CANDIDATES).alias("n_salt"))
    routed = placed(table, pivots, False, ["id", "label", "v"]).join(groups, "label")
    routed = routed.where((F.col("group") == OPEN) | (F.col("far")[F.greatest("group", F.lit(0))] <= F.col("limit")))
    routed = routed.select("label", "group", spread(F.col("n_part")).alias("part"), part_of(F.col("n_salt")).alias("salt"), "id", "v")
    asked = anchors.join(bound.select("label", "cell", "group"), ["label", "cell"]).join(groups, ["label", "group"])
    asked = asked.select("label", "group", part_of(F.col("n_part")).alias("part"), spread(F.col("n_salt")).alias("salt"), "id", "v")
    by = ["label", "group", "part", "salt"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 3), np.int64)]
        if left.num_rows and right.num_rows:
            a, b = (t.column("id").to_numpy() for t in (left, right))
            right = right.take(pa.array(np.argsort(b)))
            b = np.sort(b)
            x, y = (matrix(t.column("v").to_pylist()) for t in (left, right))
            for i, j, s in scores_in(x, y, longest):
                mine, theirs, s = a[i], b[j], s.astype(np.float64)
                s[mine[:, None] == theirs[None, :]] = -np.inf
                key = s * s.shape[1] - np.arange(s.shape[1])  # equal scores: the smaller id first
                k = min(most, s.shape[1])
                at = np.argpartition(-key, k - 1, axis=1)[:, :k]
                found = np.stack([np.repeat(mine, k), theirs[at].ravel(), np.nan_to_num(np.take_along_axis(s, at, axis=1), neginf=0).astype(np.int64).ravel()], axis=1)
                out.append(found[found[:, 0] != found[:, 1]])
        found = np.concatenate(out)
        found = found[np.lexsort((found[:, 1], -found[:, 2], found[:, 0]))]
        place = np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0])
        return pa.table(dict(zip(("anchor_id", "other_id", "score"), map(pa.array, found[place < most].T), strict=True)))

    return top(best(asked, routed, by, run, PAIR), ["anchor_id"], most)


def negatives(table: DataFrame, span: DataFrame, found: DataFrame, pivots, longest: int, most: int) -> DataFrame:
    """``anchor_id, positive_id, other_id, score, positive_score, rank``: the first ``most`` rows of other labels in each positive's band."""
    low, high = F.expr(f"(score * {LOW} + 99) div 100"), F.expr(f"(score * {HIGH}) div 100")  # rounded up and down; a negative score has no band
    bands = found.where("score >= 0").select("anchor_id", F.struct(F.col("other_id").alias("id"), "score", low.alias("low"), high.alias("high")).alias("band"))
    bands = bands.where("band.low <= band.high").groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list("band")).alias("bands"))
    asked = placed(table.join(bands, "id"), pivots, True, ["id", "label", "norm", "v", "bands"]).withColumn("near", F.col("far")[F.col("cell")])
    away = lambda s: F.sqrt(F.greatest(F.col("norm") + longest - 2.0 * s, F.lit(0.0)))
    outer = F.max(F.col("near") + away(F.array_min("bands.low"))) * (1 + SLACK)
    inner = F.min(away(F.array_max("bands.high")) - F.col("near")) * (1 - SLACK) - SLACK
    cells = asked.groupBy("cell").agg(inner.alias("inner"), outer.alias("outer"), F.count("*").alias("n")).orderBy("cell").collect()  # at most one per pivot
    schema = "anchor_id long, positive_id long, other_id long, score long, positive_score long"
    if not cells:
        return table.sparkSession.createDataFrame([], schema + ", rank int")
    each = range(len(pivots.value.x))
    all_ = span.agg(F.sum("n_label"), *(F.min(F.col("least")[k]) for k in each), *(F.max(F.col("most")[k]) for k in each)).first()
    total, least, most_far = all_[0], all_[1 : 1 + len(each)], all_[1 + len(each) :]
    group_of = {c.cell: OPEN if c.inner <= least[c.cell] and c.outer >= most_far[c.cell] else c.cell for c in cells}
    groups = {g: [c for c in cells if group_of[c.cell] == g] for g in set(group_of.values())}
    parts, salts = {g: -(-sum(c.n for c in cs) // ANCHORS) for g, cs in groups.items()}, F.lit(-(-total // CANDIDATES))
    wanted = F.array(
        *(
            F.struct(F.lit(g).alias("group"), F.lit(min(c.inner for c in cs)).alias("inner"), F.lit(max(c.outer for c in cs)).alias("outer"), F.lit(parts[g]).alias("n"))
            for g, cs in sorted(groups.items())
        )
    )
    table_of = lambda pairs: F.create_map(*(F.lit(x) for kv in sorted(pairs.items()) for x in kv))
    routed = placed(table, pivots, False, ["id", "label", "v"]).select("id", "label", "v", "far", F.explode(wanted).alias("g"))
    routed = routed.where((F.col("g.group") == OPEN) | F.col("far")[F.greatest("g.group", F.lit(0))].between(F.col("g.inner"), F.col("g.outer")))
    routed = routed.select(F.col("g.group").alias("group"), spread(F.col("g.n")).alias("part"), part_of(salts).alias("salt"), "id", "label", "v")
    asked = asked.withColumn("group", table_of(group_of)[F.col("cell")])
    asked = asked.select("group", part_of(table_of(parts)[F.col("group")]).alias("part"), spread(salts).alias("salt"), "id", "label", "v", "bands")
    by = ["group", "part", "salt"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 5), np.int64)]
        if left.num_rows and right.num_rows:
            (a, la), (b, lb) = ((t.column("id").to_numpy(), t.column("label").to_numpy()) for t in (left, right))
            x, y = (matrix(t.column("v").to_pylist()) for t in (left, right))
            sets = left.column("bands").to_pylist()
            row = np.repeat(np.arange(len(a)), [len(s) for s in sets])
            band = np.array([(p["id"], p["score"], p["low"], p["high"]) for s in sets for p in s], np.int64)
            low, high = (f.reduceat(band[:, k], np.searchsorted(row, np.arange(len(a)))) for f, k in ((np.minimum, 2), (np.maximum, 3)))
            for i, j, s in scores_in(x, y, longest):
                fit = (s >= low[i, None]) & (s <= high[i, None]) & (la[i, None] != lb[None, j])
                at, col = np.nonzero(fit)
                if not len(at):
                    continue
                score, ids = s[at, col].astype(np.int64), b[j][col]
                order = np.lexsort((ids, -score, at))
                at, score, ids = at[order], score[order], ids[order]
                # scores of one anchor fall; an anchor's scores are set off by its place, so that one search finds where each band begins
                wide = int(score.max()) + 1
                key = at * wide + (wide - 1 - score)
                mine = np.flatnonzero((row >= i.start) & (row < i.stop))
                local = row[mine] - i.start
                begin = np.searchsorted(key, local * wide + np.maximum(wide - 1 - band[mine, 3], 0))
                for k in range(most):
                    p = np.minimum(begin + k, len(key) - 1)
                    good = (begin + k < len(key)) & (at[p] == local) & (score[p] >= band[mine, 2]) & (score[p] <= band[mine, 3])
                    p, q = p[good], mine[good]
                    out.append(np.stack([a[row[q]], band[q, 0], ids[p], score[p], band[q, 1]], axis=1))
        found = np.concatenate(out)
        found = found[np.lexsort((found[:, 2], -found[:, 3], found[:, 1], found[:, 0]))]
        new = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)] if len(found) else np.zeros(0, bool)
        place = np.arange(len(found)) - np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
        return pa.table(dict(zip(("anchor_id", "positive_id", "other_id", "score", "positive_score"), map(pa.array, found[place < most].T), strict=True)))

    return top(best(asked, routed, by, run, schema), ["anchor_id", "positive_id"], most)


def mine(
    df: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of ``floor(scale * entry)``; higher ones come first, ties by smaller id. An anchor (``is_anchor``, in terms of ``id`` and ``label``) has as
    positives its first ``n_positives`` other rows of the same ``label``; for each of them come the first ``n_negatives`` rows of another label whose score is
    ``LOW`` to ``HIGH`` percent of the positive's. All, if there are fewer; so a positive with a negative score has none.

    Rows with a null id, label or vector, or with a null or non-finite entry, take no part. Rows that share an id are one: the one with the least label, then
    norm, then vector. Vectors of different lengths, or so long that scores aren't exact, are an error. An empty table, or one without anchors, gives an empty result. Other columns
    are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    table = staged(vectors(df, label, id_col, vec_col, scale))
    chosen = table.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("id", "v").collect()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not chosen:
        return spark.createDataFrame([], schema)
    longest, sizes = table.agg(F.max("norm"), F.count_distinct(F.length("v"))).first()
    if sizes > 1:
        raise ValueError("vectors of different lengths")
    pivots = spark.sparkContext.broadcast(Pivots(chosen, longest))
    span = spans(table, pivots)
    found = staged(positives(table, span, is_anchor, pivots, longest, n_positives))
    made = negatives(table, span, found, pivots, longest, n_negatives)
    return made.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df, F.col("id") % 50 == 0, label)


OP13_SQL = """
WITH rows_ AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a, rows_ b WHERE a.id % 50 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
         other_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT * FROM ranked WHERE rank <= 3
"""
