"""Role graphs: provisional neighbours and career moves over all directed pairs of roles.

Both scores compare every role with every other: a pair without a shared activity can still reach a top list through
grade and family, so pairs aren't pruned by what they share. Both sides are dealt in blocks, and a task compares two of
them. Of neighbours only the best rows of a block leave its task. Moves keep every pair with its reason: a task hands on what
its pairs have in common, the rules are applied to these rows where they are, and no pair is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import scoring
from ..lineage import cut
from .features import activity_rarity, capability_profile, grade_ranks

#: Roles of either side that one task scores against each other, and items of a slice of their matrices.
BLOCK_ROLES = 1_000
_SLICE = 4_096
#: Roles of either side that one task compares for moves, and pairs of a batch of its rows.
MOVE_ROLES = 2_000
_BATCH = 250_000


def readiness(profile: DataFrame, digits: int | None = None) -> DataFrame:
    """(a_role_id, b_role_id, readiness) of sources `a` for targets `b`: mean of min(level / wanted level, 1) over the
    target's capabilities, of which those of level 0 count in the mean only. Pairs without common ones are left out.

    Roles of one profile have the same values, so these are computed between profiles, rounded there, and dealt to the roles.
    """
    kinds = profile.groupBy("role_id").agg(F.array_sort(F.collect_list(F.struct("capability", "level"))).alias("levels"))
    kinds = cut(kinds.join(kinds.groupBy("levels").agg(F.min("role_id").alias("kind")), "levels").select("role_id", "kind", "levels"))
    one = kinds.where("role_id = kind").select("kind", F.size("levels").alias("n"), F.explode("levels").alias("x")).select("kind", "n", "x.*")
    target = one.where("level <> 0").select("capability", F.col("kind").alias("b_kind"), F.col("level").alias("wanted"), "n")
    source = one.select("capability", F.col("kind").alias("a_kind"), "level")
    value = F.sum(F.least(F.col("level") / F.col("wanted"), F.lit(1.0))) / F.first("n")
    found = cut(target.join(source, "capability").groupBy("a_kind", "b_kind").agg((value if digits is None else F.round(value, digits)).alias("readiness")))
    a, b = (kinds.select(F.col("kind").alias(f"{p}_kind"), F.col("role_id").alias(f"{p}_role_id")) for p in "ab")
    return found.join(a, "a_kind").join(b, "b_kind").where("a_role_id <> b_role_id").select("a_role_id", "b_role_id", "readiness")


def _ranked(scored: DataFrame, score: Column, tie: Column, keep: int | None, name: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("a_role_id").orderBy(score.desc(), tie))
    rows = scored.withColumn(name, place)
    return rows.where(F.col(name) <= keep) if keep else rows


def _entries(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, value) of all entries of a column of lists; a null list is empty."""
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    return pc.list_parent_indices(lists).to_numpy(), flat.field("item").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False).astype(float)


def _product(a: tuple, b: tuple, shape: tuple[int, int], n: int) -> np.ndarray:
    """Sums of a's values times b's over the items both have, by (row of a, row of b); items go in slices of bounded width."""
    out = np.zeros(shape)
    for first in range(0, n, _SLICE):
        sides = []
        for (row, code, value), size in zip((a, b), shape, strict=True):
            part = (code >= first) & (code < first + _SLICE)
            side = np.zeros((size, min(_SLICE, n - first)))
            side[row[part], code[part] - first] = value[part]
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _block_scores(asked: pa.Table, stored: pa.Table, w: scoring.NeighbourWeights) -> dict[str, np.ndarray]:
    """The parts of the neighbour score, as matrices of asked by stored roles."""
    shape = asked.num_rows, stored.num_rows

    def coded(column: str) -> tuple[tuple, tuple, int]:
        (ra, ia, va), (rb, ib, vb) = _entries(asked, column), _entries(stored, column)
        names, code = np.unique(np.concatenate([ia, ib]), return_inverse=True)
        return (ra, code[: len(ia)], va), (rb, code[len(ia) :], vb), len(names)

    a, b, n = coded("items")
    shared = _product(a, (b[0], b[1], np.ones(len(b[1]))), shape, n)
    totals = [np.bincount(x[0], x[2], minlength=size) for x, size in zip((a, b), shape, strict=True)]
    union = totals[0][:, None] + totals[1] - shared
    a, b, n = coded("levels")
    ready = np.zeros(shape)
    for wanted in np.unique(b[2][b[2] != 0]).tolist():
        at = b[2] == wanted
        ready += _product((a[0], a[1], np.minimum(a[2] / wanted, 1)), (b[0][at], b[1][at], np.ones(int(at.sum()))), shape, n)
    ready /= np.maximum(1, np.bincount(b[0], minlength=shape[1]))
    delta = stored.column("grade_rank").to_numpy() - asked.column("grade_rank").to_numpy()[:, None]
    families = pa.concat_arrays([x for t in (asked, stored) for x in t.column("sub_family").chunks]).dictionary_encode().indices
    families = families.fill_null(-1).to_numpy(zero_copy_only=False)
    same = (families[: shape[0], None] == families[shape[0] :]) & (families[shape[0] :] >= 0)
    grade = np.where(np.isnan(delta), 0, np.maximum(0, 1 - np.abs(delta) / w.grade_span))
    work = np.where(union > 0, shared / np.where(union > 0, union, 1), 0)
    raw = w.readiness * ready + w.activities * work + w.sub_family * same + w.grade * grade
    return {"delta": delta, "readiness": ready, "work": work, "same_sub_family": same, "grade": grade, "raw": raw}


def _best_of_blocks(frame: DataFrame, w: scoring.NeighbourWeights, rounded: bool, block_rows: int = BLOCK_ROLES) -> DataFrame:
    """The parts of the score for the best neighbours of each role in every block of roles. Both sides are dealt in blocks of
    bounded size; a task scores two of them against each other, and only its best rows leave it."""
    key, kind = frame.schema["role_id"].dataType.simpleString(), pa.bool_()
    schema = f"a_role_id {key}, b_role_id {key}, delta double, readiness double, work double, same_sub_family boolean, grade double, raw double, ranked double"

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        stored = stored.rename_columns([c.removeprefix("b_") for c in stored.column_names])
        asked, stored = asked.sort_by("role_id"), stored.sort_by([("role_id", "descending")])  # larger ids first on ties
        a_ids, b_ids = asked.column("role_id").to_numpy(), stored.column("role_id").to_numpy()
        parts = _block_scores(asked, stored, w)
        parts["ranked"] = np.floor(parts["raw"] * 1e12 + 0.5) / 1e12 if rounded else parts["raw"]
        score = np.where(a_ids[:, None] == b_ids, -np.inf, parts["ranked"])
        place = max(0, score.shape[1] - w.neighbours)
        least = np.partition(score, place, axis=1)[:, place] if score.size else np.zeros(len(a_ids))
        row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        order = np.lexsort((column, -score[row, column], row))
        row, column = row[order], column[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < w.neighbours
        row, column = row[kept], column[kept]
        found = {name: values[row, column] for name, values in parts.items()}
        columns = [pa.array(a_ids[row]), pa.array(b_ids[column]), *(pa.array(v, kind) if name == "same_sub_family" else pa.array(v, pa.float64(), from_pandas=True) for name, v in found.items())]
        return pa.Table.from_arrays(columns, names=["a_role_id", "b_role_id", *found])

    n = frame.count()
    i = max(1, -(-n // block_rows))
    j = max(i, -(-frame.sparkSession.sparkContext.defaultParallelism // i))
    block = lambda k: F.pmod(F.xxhash64("role_id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = frame.withColumn("i", block(i)).withColumn("j", every(j))
    # other names on the other side: the optimiser takes columns of one origin for each other and drops them
    given = frame.withColumn("j", block(j)).withColumn("i", every(i)).select(*(F.col(c).alias(f"b_{c}") for c in asked.columns))
    return asked.groupBy("i", "j").cogroup(given.groupBy("b_i", "b_j")).applyInArrow(run, schema)


def neighbours(roles: DataFrame, links: DataFrame, capabilities: DataFrame, w: scoring.NeighbourWeights = scoring.NeighbourWeights(), rounded: bool = False, digits: int = 12) -> DataFrame:
    """The best neighbours of every role, ranked by raw score, then by the larger id.

    `rounded` ranks on 12 decimals, so that another engine with another order of summation gives the same ranks; values are shown with `digits` decimals.
    """
    rarity = activity_rarity(links, roles).select("activity", (1 - F.col("share")).alias("weight"))
    items = links.select("role_id", "activity").distinct().join(rarity, "activity", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    frame = roles.join(grade_ranks(roles), "rung", "left").select("role_id", "sub_family", F.col("grade_rank").cast("double"))
    lists = items.groupBy("role_id").agg(F.collect_list(F.struct(F.col("activity").alias("item"), F.col("weight").alias("value"))).alias("items"))
    levels = capability_profile(capabilities).groupBy("role_id").agg(F.collect_list(F.struct(F.col("capability").alias("item"), F.col("level").cast("double").alias("value"))).alias("levels"))
    frame = cut(frame.join(lists, "role_id", "left").join(levels, "role_id", "left"))
    best = _best_of_blocks(frame, w, rounded)
    best = _ranked(best, F.col("ranked"), F.desc("b_role_id"), w.neighbours, "neighbour_rank")
    shown = lambda c, k: F.round(k * F.col(c).cast("double"), digits)
    return best.select(
        F.col("a_role_id").alias("role_id"),
        F.col("b_role_id").alias("neighbour_role_id"),
        "neighbour_rank",
        F.col("delta").cast("int").alias("grade_step"),
        F.round("readiness", digits).alias("readiness"),
        F.round("work", digits).alias("work_similarity"),
        "same_sub_family",
        F.round("grade", digits).alias("grade_proximity"),
        shown("readiness", w.readiness).alias("readiness_part"),
        shown("work", w.activities).alias("activity_part"),
        shown("same_sub_family", w.sub_family).alias("sub_family_part"),
        shown("grade", w.grade).alias("grade_part"),
        F.round("raw", digits).alias("score"),
    )


def neighbour_metrics(edges: DataFrame) -> DataFrame:
    """Edges, smallest and largest number of neighbours, and the range of scores, in one row."""
    degree = edges.groupBy("role_id").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("score").alias("total"))
    return degree.agg(
        F.sum("n").alias("edges"), F.min("n").alias("least_neighbours"), F.max("n").alias("most_neighbours"), F.min("lo").alias("least_score"), F.max("hi").alias("best_score"), (F.sum("total") / F.sum("n")).alias("mean_score")
    )


def unreconciled(edges: DataFrame, tolerance: float = 2e-6) -> DataFrame:
    """Edges whose parts don't add up to the score."""
    return edges.where(F.abs(F.col("score") - (F.col("readiness_part") + F.col("activity_part") + F.col("sub_family_part") + F.col("grade_part"))) > tolerance)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers of the columns' values, the same in all, -1 for null."""
    both = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks()
    codes = both.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _pair_terms(frame: DataFrame, block_rows: int = MOVE_ROLES, batch: int = _BATCH) -> DataFrame:
    """What every ordered pair of different roles has in common: (a_role_id, b_role_id, shared, shared_weight, smaller,
    weight, same_family, same_sub, same_specialisation, tier, delta). `smaller` is the smaller number of items, `weight` the sum of both
    totals; `same_family`, `tier` and `delta` are null where they aren't known.

    `frame` has (role_id, family, sub_family, specialisation, rung, items, weights, size, weight, tiers): numbers of items
    with their weights, and (family, tier) of adjacent families.
    """
    key = frame.schema["role_id"].dataType.simpleString()
    schema = f"a_role_id {key}, b_role_id {key}, shared int, shared_weight double, smaller int, weight double, same_family boolean, same_sub boolean, same_specialisation boolean, tier int, delta int"
    number = lambda t, c: t.column(c).to_numpy()

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        stored = stored.rename_columns([c.removeprefix("b_") for c in stored.column_names])
        n = stored.num_rows
        if not n or not asked.num_rows:
            return arrow.empty_table()
        (ids, other), sub, spec = (_codes(asked.column(c), stored.column(c)) for c in ("role_id", "sub_family", "specialisation"))
        near = pc.list_flatten(asked.column("tiers"))
        family = _codes(asked.column("family"), stored.column("family"), pc.struct_field(near, "family"))
        tiers = np.full((max(map(lambda x: x.max(initial=-1), family)) + 2,) * 2, -1)  # the last row and column are of null
        tiers[family[0][pc.list_parent_indices(asked.column("tiers")).to_numpy()], family[2]] = pc.struct_field(near, "tier").to_numpy()
        held, order = number(asked, "size"), np.argsort(pc.list_flatten(stored.column("items")).to_numpy(), kind="stable")
        theirs = pc.list_flatten(stored.column("items")).to_numpy()[order]
        them = pc.list_parent_indices(stored.column("items")).to_numpy()[order]
        row, item, weight = pc.list_parent_indices(asked.column("items")).to_numpy(), pc.list_flatten(asked.column("items")).to_numpy(), pc.list_flatten(asked.column("weights")).to_numpy()
        rungs, no_rung = zip(*((t.column("rung").fill_null(0).to_numpy(), t.column("rung").is_null().to_numpy()) for t in (asked, stored)), strict=True)
        tables, step = [], max(1, batch // n)
        for first in range(0, asked.num_rows, step):
            at = slice(first, first + step)
            size = len(ids[at])
            mine = slice(*np.searchsorted(row, [first, first + size]))
            least, most = (np.searchsorted(theirs, item[mine], side) for side in ("left", "right"))
            many = most - least
            place = np.arange(many.sum()) + np.repeat(least - (np.cumsum(many) - many), many)
            cell = np.repeat(row[mine] - first, many) * n + them[place]
            shared = np.bincount(cell, minlength=size * n).astype(np.int32)
            shared_weight = np.bincount(cell, np.repeat(weight[mine], many), minlength=size * n)
            wide = lambda x: np.ascontiguousarray(x).reshape(-1)
            pair = lambda f, a, b: wide(f(a[at][:, None], b))
            same = lambda a, b: pair(np.equal, a, b) & np.repeat(a[at] >= 0, n)
            tier = wide(tiers[family[0][at][:, None], family[1]])
            unknown = pair(np.logical_or, family[0] < 0, family[1] < 0)
            rung_unknown = pair(np.logical_or, *no_rung)
            columns = [
                asked.column("role_id").take(pa.array(np.repeat(np.arange(first, first + size), n))).combine_chunks(), stored.column("role_id").take(pa.array(np.tile(np.arange(n), size))).combine_chunks(),
                pa.array(shared), pa.array(shared_weight), pa.array(pair(np.minimum, held, number(stored, "size"))), pa.array(pair(np.add, number(asked, "weight"), number(stored, "weight"))),
                pa.array(pair(np.equal, family[0], family[1]), mask=unknown), pa.array(same(*sub)), pa.array(same(*spec)),
                pa.array(tier.astype(np.int32), mask=tier < 0), pa.array(pair(np.subtract, *rungs).astype(np.int32), mask=rung_unknown),
            ]
            table = pa.Table.from_arrays(columns, schema=arrow)
            different = pair(np.not_equal, ids, other)
            tables.append(table if different.all() else table.filter(pa.array(different)))
        return pa.concat_tables(tables)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    blocks = max(1, -(-frame.count() // block_rows))
    block, every = F.pmod(F.xxhash64("role_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = frame.withColumn("i", block).withColumn("j", every)
    given = frame.drop("weights", "tiers").withColumn("j", block).withColumn("i", every)
    # other names on the other side: the optimiser takes columns of one origin for each other and drops them
    given = given.select(*(F.col(c).alias(f"b_{c}") for c in given.columns))
    return asked.groupBy("i", "j").cogroup(given.groupBy("b_i", "b_j")).applyInArrow(run, schema)


def move_scores(roles: DataFrame, links: DataFrame, adjacency: DataFrame, w: scoring.MoveWeights = scoring.MoveWeights(), digits: int | None = None, block_rows: int = MOVE_ROLES) -> DataFrame:
    """Score and reasons of every move between active roles; a rung of 0 is the most senior. `digits` rounds the values shown."""
    active = roles.where("status = 'active'").select("role_id", "family", "sub_family", "specialisation", F.col("rung").cast("int").alias("rung"))
    rarity = cut(activity_rarity(links, roles).select("activity", F.coalesce("rarity", F.lit(0.0)).alias("value"), F.monotonically_increasing_id().alias("item")))
    items = links.select("role_id", "activity").distinct().join(rarity, "activity").groupBy("role_id").agg(F.collect_list(F.struct("item", "value")).alias("x"), F.count("*").cast("int").alias("size"), F.sum("value").alias("weight"))
    items = items.select("role_id", F.col("x.item").alias("items"), F.col("x.value").alias("weights"), "size", "weight")
    to_family = lambda c: F.col(c).try_cast(active.schema["family"].dataType)
    tiers = adjacency.select(to_family("source").alias("family"), to_family("target").alias("target"), F.col("tier").cast("int").alias("tier")).where("family <> target and tier is not null")
    tiers = tiers.groupBy("family").agg(F.collect_list(F.struct(F.col("target").alias("family"), "tier")).alias("tiers"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    frame = active.join(items, "role_id", "left").join(tiers, "family", "left")
    frame = frame.select("role_id", "family", "sub_family", "specialisation", "rung", none("items", "bigint"), none("weights", "double"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("weight", F.lit(0.0)).alias("weight"), none("tiers", tiers.schema["tiers"].dataType.elementType.simpleString()))
    tier, delta, same, smaller = F.col("tier"), F.col("delta"), F.col("same_family"), F.col("smaller")
    pairs = _pair_terms(cut(frame), block_rows)
    pairs = pairs.withColumns(
        {
            "plain": scoring.overlap_coefficient(F.col("shared"), smaller, smaller),
            "rare": scoring.weighted_jaccard(F.col("shared_weight"), F.col("weight"), F.lit(0.0)),
            "occupation": scoring.occupation_value(F.coalesce(same, F.lit(False)), F.col("same_sub"), F.col("same_specialisation"), w),
            "adjacency": F.when(same, F.lit(0.0)).otherwise(scoring.adjacency_value(tier, w)),
            "grade": scoring.grade_value(delta, w),
        }
    )
    score = w.plain * F.col("plain") + w.rare * F.col("rare") + w.occupation * F.col("occupation") + w.adjacency * F.col("adjacency") + w.grade * F.col("grade")
    # `round` of Spark goes by decimals, which takes longer than all else here
    to = lambda c, n: F.floor(c * F.lit(10.0**n) + 0.5) / F.lit(10.0**n)
    pairs = pairs.withColumn("score", score).withColumn("ranked", to(F.col("score"), 12))
    families = F.when(same.isNotNull(), 1), F.when(same, 1).when(~same, 0)
    reason = lambda down: scoring.move_reason(smaller, smaller, *families, tier, delta, F.col("ranked"), w, down)
    shown = lambda c: F.col(c) if digits is None else to(F.col(c), digits).alias(c)
    return pairs.select(
        F.col("a_role_id").alias("source_role_id"), F.col("b_role_id").alias("candidate_role_id"), *map(shown, ("plain", "rare", "occupation", "adjacency", "grade")),
        "tier", delta.alias("grade_delta"), shown("score"), (F.col("ranked") >= w.floor).alias("above_floor"), reason(False).alias("reason_default"), reason(True).alias("reason_down"),
    )


def ranked_pools(scores: DataFrame, digits: int | None = 12) -> DataFrame:
    """Adds rank_default and rank_down: places by score, then by the smaller id, among the moves that are offered."""
    score = F.round("score", digits) if digits else F.col("score")
    for reason, rank in (("reason_default", "rank_default"), ("reason_down", "rank_down")):
        order = Window.partitionBy("source_role_id", F.col(reason).isNull()).orderBy(score.desc(), "candidate_role_id")
        scores = scores.withColumn(rank, F.when(F.col(reason).isNull(), F.row_number().over(order)))
    return scores


def page_of_pool(pool: DataFrame, rank: str, cursor: int, slots: int = 3, anchors: tuple = ()) -> tuple[list, str, int]:
    """(candidates, counter text, next cursor) of one page of a ranked pool of one role, anchors left out; wraps around."""
    if not 1 <= slots <= 3:
        raise ValueError("a page has one to three slots")
    rows = pool.where(F.col(rank).isNotNull() & ~F.col("candidate_role_id").isin(*anchors)) if anchors else pool.where(F.col(rank).isNotNull())
    total = rows.count()
    if not total:
        return [], "0 of 0", 0
    first = cursor % total
    place = F.row_number().over(Window.partitionBy("source_role_id").orderBy(rank))
    page = rows.withColumn("place", place).where(F.col("place").between(first + 1, first + slots)).orderBy("place").collect()
    last = first + len(page)
    return [r.candidate_role_id for r in page], f"{first + 1}–{last} of {total}", 0 if last >= total else last


def fan_page(pools: DataFrame, rank: str, cursor: int, slots: int = 3, totals: DataFrame | None = None) -> DataFrame:
    """The page from `cursor` of every role's pool; negative cursors count as 0, those past the end start again. `totals`
    (source_role_id, total) has the pools' sizes where only their first places are given."""
    rows = pools.where(F.col(rank).isNotNull())
    rows = rows.join(totals, "source_role_id") if totals is not None else rows.withColumn("total", F.count("*").over(Window.partitionBy("source_role_id")))
    first = F.when(F.lit(max(0, cursor)) >= F.col("total"), F.lit(0)).otherwise(F.lit(max(0, cursor)))
    rows = rows.withColumn("first", first).where((F.col(rank) > F.col("first")) & (F.col(rank) <= F.col("first") + slots))
    counter = F.concat((F.col("first") + 1).cast("string"), F.lit("–"), F.least(F.col("first") + slots, F.col("total")).cast("string"), F.lit(" of "), F.col("total").cast("string"))
    return rows.select("source_role_id", "candidate_role_id", (F.col(rank) - F.col("first")).alias("slot"), counter.alias("counter"))


def move_readiness(roles: DataFrame, links: DataFrame, adjacency: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """Counts of what the scores need, blockers, and whether all is ready, in one row; all roles count here."""
    has = links.select("role_id").distinct().withColumn("linked", F.lit(1))
    counts = roles.join(has, "role_id", "left").agg(
        F.count("*").alias("roles"), F.count("linked").alias("with_activities"), F.count("family").alias("with_family"), F.count("rung").alias("with_rung"), F.countDistinct("family").alias("families")
    )
    cells = adjacency.agg(F.count("*").alias("adjacency_cells"))
    rows = counts.crossJoin(cells)
    blockers = F.array_compact(
        F.array(
            F.when(F.col("with_activities") == 0, "no_activities"),
            F.when(F.col("with_family") < F.col("roles"), "missing_families"),
            F.when(F.col("with_rung") < F.col("roles"), "missing_grade_rungs"),
            F.when(F.col("adjacency_cells") < F.col("families") * (F.col("families") - 1), "incomplete_adjacency"),
        )
    )
    return rows.withColumn("blockers", F.array_join(blockers, "|")).withColumn("ready", F.size(blockers) == 0)


def require_ready(readiness_row: DataFrame) -> None:
    """Refuses to publish while anything blocks."""
    row = readiness_row.first()
    if not row.ready:
        raise ValueError(f"not ready: {row.blockers}")
