"""Assignment of components too large for one task (E11), and the ordered merge of such components.

State lives in checkpointed tables. The assignment is solved in regions of the graph side by side; regions grow
until every search ends inside of one. Nothing is ever collected into a task beyond a stated number of pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from gridtally.operators.matching import TIE_BITS, join_potential, local_graph, settle, split_potential
from gridtally.session import cut_lineage, join_keys

#: Pairs of a region in the first round; each further round has regions GROWTH times as large, up to the pairs a task can hold.
REGION_PAIRS, GROWTH, TASK_PAIRS = 20_000, 4, 2_000_000
#: Rounds without a join between cells after which regions are taken as they are.
IDLE = 4
#: A missing pair as an exact decimal, above the sum of all costs of a component.
ALONE = 10**37
POTENTIAL = ["missing", "price", "tie"]


def _contracted(links: DataFrame, cells: DataFrame, turn: int, most: int, host: int) -> tuple[DataFrame, DataFrame]:
    """One round of joining cells: each cell without a coin joins the neighbour with a coin of least hash.

    ``links``: distinct (n, a, b) between cells, both ways; ``cells``: (n, a, size). Cells of more than ``most`` pairs join none, and those
    of more than ``host`` are joined by none. Returns the cells with their new name (n, a, size, to) and the links between new cells.
    """
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 1
    hosts = cells.where(coin("a") & (F.col("size") <= host)).select("n", F.col("a").alias("b"))
    guests = cells.where(~coin("a") & (F.col("size") <= most)).select("n", "a")
    meet = links.where(~coin("a") & coin("b")).join(guests, ["n", "a"], "left_semi").join(hosts, ["n", "b"], "left_semi")
    joined = meet.groupBy("n", "a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), "b")).alias("m")).select("n", "a", F.col("m.b").alias("to"))
    names = cut_lineage(cells.join(joined, ["n", "a"], "left").select("n", "a", "size", F.coalesce("to", "a").alias("to")))
    ends = names.select("n", F.col("a").alias("b"), F.col("to").alias("to_b"))
    new = links.join(names.drop("size"), ["n", "a"]).join(ends, ["n", "b"]).where("to <> to_b").select("n", F.col("to").alias("a"), F.col("to_b").alias("b")).distinct()
    return names, cut_lineage(new)


def _settle_region(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lets the waiting predictions of one region enter; returns the state of its objects, predictions first."""
    preds, gts, g_at, p_at, rows = local_graph(pdf)
    mate, owner = [-1] * len(preds), [-1] * len(gts)
    u, v, inside, done = [0] * len(preds), [0] * len(gts), [False] * len(gts), [False] * len(preds)
    for p, g, held, taken, own, fixed, a, b in zip(
        p_at, g_at, pdf["held"].tolist(), pdf["taken"].tolist(), pdf["own"].tolist(), pdf["done"].tolist(), pdf[[f"u_{c}" for c in POTENTIAL]].itertuples(index=False, name=None), pdf[[f"v_{c}" for c in POTENTIAL]].itertuples(index=False, name=None)
    ):
        u[p], v[g], done[p], inside[g] = join_potential(*map(int, a)), join_potential(*map(int, b)), fixed, own
        if held:
            mate[p], owner[g] = g, p
        elif taken and owner[g] < 0:
            owner[g] = -2
    put_off = set(settle(rows, [p for p in range(len(preds)) if not done[p]], mate, owner, u, v, inside))
    n = pdf["n"].iloc[0]
    out = [(n, preds[p], gts[g] if g >= 0 else None, *split_potential(u[p]), p not in put_off) for p, g in enumerate(mate)]
    out += [(n, None, gts[g], *split_potential(x), True) for g, x in enumerate(v) if inside[g]]
    return pd.DataFrame(out, columns=["n", "pred_id", "gt_id", *POTENTIAL, "done"], dtype=object)


def match_by_regions(
    edges: DataFrame, comp: list[str], potentials: bool = False, region_pairs: int = REGION_PAIRS, task_pairs: int = TASK_PAIRS,
) -> DataFrame:
    """The best assignment of each component as (comp, pred_id, gt_id), whatever its size.

    ``edges``: comp, pred_id, gt_id, _c, _h. Predictions enter along cheapest paths in any order, so all regions of the graph work at the
    same time, each in one task and on its own objects; a search that leaves its region waits for the next round. Searches in
    different regions do not disturb each other: they raise potentials of their own predictions and lower those of their
    own truth only, which no other pair can violate. Regions are made by joining neighbouring cells at random and
    grow by GROWTH a round, from ``region_pairs`` on. Predictions whose search is still open in regions of ``task_pairs`` enter by joins,
    and potentials are not known then.
    """
    numbers = cut_lineage(edges.select(*comp).distinct().withColumn("n", F.monotonically_increasing_id()))
    e = cut_lineage(join_keys(edges, numbers, comp).select("n", "pred_id", "gt_id", "_c", "_h"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in POTENTIAL]
    cell = lambda side, c: F.xxhash64(F.lit(side), F.col("n"), F.col(c))
    no_mate = F.lit(None).cast(e.schema["gt_id"].dataType).alias("mate")
    # A component that fits a first region is one from the start; elsewhere every object is a cell of its own.
    whole = e.groupBy("n").agg((F.count(F.lit(1)) <= region_pairs).alias("whole"))
    home = lambda side, c: F.when(F.col("whole"), F.xxhash64("n")).otherwise(cell(side, c)).alias("a")
    preds = e.groupBy("n", "pred_id").agg(F.count(F.lit(1)).alias("size")).join(whole, "n")
    preds = cut_lineage(preds.select("n", "pred_id", "size", no_mate, *zero, F.lit(False).alias("done"), home(0, "pred_id")))
    gts = cut_lineage(e.select("n", "gt_id").distinct().join(whole, "n").select("n", "gt_id", *zero, home(1, "gt_id")))
    links = e.join(whole.where("not whole"), "n").select("n", cell(0, "pred_id").alias("a"), cell(1, "gt_id").alias("b"))
    links = cut_lineage(links.unionByName(links.select("n", F.col("b").alias("a"), F.col("a").alias("b"))))
    sizes = preds.select("n", "a", "size").unionByName(gts.select("n", "a", F.lit(0).cast("bigint").alias("size")))
    cells = sizes.groupBy("n", "a").agg(F.sum("size").alias("size"))
    all_pairs, n_cells, n_links = e.count(), cells.count(), links.count()
    turn, target, was_left = 0, min(region_pairs, task_pairs), None
    while True:
        idle, turned = 0, False
        while n_links and idle < IDLE and all_pairs < target * n_cells:
            names, links = _contracted(links, cells, turn, min(target, task_pairs // GROWTH), task_pairs // GROWTH)
            cells = names.groupBy("n", F.col("to").alias("a")).agg(F.sum("size").alias("size"))
            preds, gts = (df.join(names.drop("size"), ["n", "a"]).drop("a").withColumnRenamed("to", "a") for df in (preds, gts))
            before, n_cells, n_links = n_cells, cells.count(), links.count()
            idle, turn, turned = idle + 1 if n_cells == before else 0, turn + 1, True
        if turned:
            preds, gts = cut_lineage(preds), cut_lineage(gts)
        weight = preds.groupBy("n", "a").agg(F.sum("size").alias("pairs"), F.count_if(~F.col("done")).alias("waiting"))
        ready = weight.where((F.col("waiting") > 0) & (F.col("pairs") <= task_pairs)).select("n", "a")
        mine = preds.join(ready, ["n", "a"], "left_semi").select("n", "pred_id", F.col("a").alias("region"), "mate", "done", *[F.col(c).alias(f"u_{c}") for c in POTENTIAL])
        owned = preds.where("mate is not null").select("n", F.col("mate").alias("gt_id"), F.lit(True).alias("taken"))
        truth = gts.select("n", "gt_id", F.col("a").alias("gt_region"), *[F.col(c).alias(f"v_{c}") for c in POTENTIAL]).join(owned, ["n", "gt_id"], "left")
        x = e.join(mine, ["n", "pred_id"]).join(truth, ["n", "gt_id"]).select(
            "n", "region", "pred_id", "gt_id", "_c", "_h", F.coalesce(F.col("mate") == F.col("gt_id"), F.lit(False)).alias("held"), F.coalesce("taken", F.lit(False)).alias("taken"),
            (F.col("gt_region") == F.col("region")).alias("own"), "done", *[f"u_{c}" for c in POTENTIAL], *[f"v_{c}" for c in POTENTIAL],
        )
        kinds = {f.name: f.dataType.simpleString() for f in e.schema.fields}
        schema = f"n bigint, pred_id {kinds['pred_id']}, gt_id {kinds['gt_id']}, missing bigint, price bigint, tie bigint, done boolean"
        news = cut_lineage(x.groupBy("n", "region").applyInPandas(_settle_region, schema))
        preds = cut_lineage(_renewed(preds, news.where("pred_id is not null").withColumn("mate", F.col("gt_id")), "pred_id", ["mate", *POTENTIAL, "done"]))
        gts = cut_lineage(_renewed(gts, news.where("pred_id is null"), "gt_id", POTENTIAL))
        left = preds.where(~F.col("done")).count()
        if not left:
            break
        if not n_links or (target >= task_pairs and left == was_left):
            preds = _enter_by_joins(e, preds)
            if potentials:
                raise RuntimeError("potentials are known only where every search ends inside of a region")
            break
        target, was_left = min(target * GROWTH, task_pairs), left
    back = lambda df: df.join(numbers, "n")
    if not potentials:
        return back(preds.where("mate is not null").select("n", "pred_id", F.col("mate").alias("gt_id"))).select(*comp, "pred_id", "gt_id")
    no_pred = F.lit(None).cast(e.schema["pred_id"].dataType).alias("pred_id")
    both = preds.select("n", "pred_id", F.col("mate").alias("gt_id"), *POTENTIAL).unionByName(gts.select("n", no_pred, "gt_id", *POTENTIAL))
    return back(both).select(*comp, "pred_id", "gt_id", *POTENTIAL)


def _renewed(state: DataFrame, news: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """``state`` with ``columns`` replaced wherever ``news`` has the node."""
    fresh = news.select("n", node, F.struct(*columns).alias("_new"))
    x = state.join(fresh, ["n", node], "left")
    return x.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in state.columns])


def _enter_by_joins(edges: DataFrame, preds: DataFrame) -> DataFrame:
    """The predictions that still wait enter one per component and round, in id order, along cheapest paths found by joins.

    A path is sought through the residual graph (Bellman-Ford), ending at a free truth object or leaving one prediction alone.
    """
    exact = lambda c: c.cast(DecimalType(38, 0))
    e = cut_lineage(edges.select("n", "pred_id", "gt_id", exact(F.col("_c").cast(DecimalType(18, 0)) * F.lit(str(1 << TIE_BITS)).cast(DecimalType(20, 0)) + F.col("_h")).alias("cost")))
    pk, gk = ["n", "pred_id"], ["n", "gt_id"]
    match = cut_lineage(preds.where("mate is not null").select("n", "pred_id", F.col("mate").alias("gt_id")).join(e, [*pk, "gt_id"]))
    waiting = cut_lineage(preds.where(~F.col("done")).select(*pk))
    alone = exact(F.lit(str(ALONE)))
    while True:
        start = cut_lineage(waiting.groupBy("n").agg(F.min("pred_id").alias("pred_id")))
        if start.isEmpty():
            break
        # dist: cheapest alternating path from the start to each truth object, with the prediction before it.
        dist = cut_lineage(start.join(e, pk).select(*gk, F.col("pred_id").alias("via"), F.col("cost").alias("d")))
        while True:
            held = match.select(*gk, "pred_id", F.col("cost").alias("back"))
            step = dist.join(held, gk).select("n", "pred_id", exact(F.col("d") - F.col("back")).alias("base"))
            more = step.join(e, pk).select(*gk, F.col("pred_id").alias("via"), exact(F.col("base") + F.col("cost")).alias("d"))
            better = more.groupBy(*gk).agg(F.min(F.struct("d", "via")).alias("m")).select(*gk, F.col("m.via").alias("via"), F.col("m.d").alias("d"))
            old = dist.select(*gk, F.col("via").alias("via0"), F.col("d").alias("d0"))
            both = cut_lineage(old.join(better, gk, "full_outer").withColumn("wins", F.col("d0").isNull() | F.coalesce(F.col("d") < F.col("d0"), F.lit(False))))
            pick = lambda c: F.when(F.col("wins"), F.col(c)).otherwise(F.col(f"{c}0")).alias(c)
            dist = both.select(*gk, pick("via"), pick("d"))
            if both.where("wins").isEmpty():
                break
        dist = cut_lineage(dist)
        # Ends: a free truth object, or a prediction on the tree that gives up its partner.
        free = dist.join(match, gk, "left_anti").select("n", F.col("d").alias("total"), F.lit(0).alias("kind"), F.col("gt_id").alias("at"))
        drop = dist.join(match.select(*gk, F.col("cost").alias("back")), gk).select("n", exact(F.col("d") - F.col("back") + alone).alias("total"), F.lit(1).alias("kind"), F.col("gt_id").alias("at"))
        skip = start.select("n", alone.alias("total"), F.lit(2).alias("kind"), F.lit(None).cast(e.schema["gt_id"].dataType).alias("at"))
        end = free.unionByName(drop).unionByName(skip).groupBy("n").agg(F.min(F.struct("total", "kind", "at")).alias("m"))
        end = cut_lineage(end.select("n", F.col("m.kind").alias("kind"), F.col("m.at").alias("gt_id")))
        # A prediction that gives up its partner is out; otherwise its truth object is re-assigned along the path.
        lost = end.where("kind = 1").join(match, gk).select(*pk)
        match = cut_lineage(match.join(lost, pk, "left_anti"))
        cursor = cut_lineage(end.where("kind < 2").select(*gk))
        while not cursor.isEmpty():
            pairs = cursor.join(dist.select(*gk, F.col("via").alias("pred_id")), gk)
            now = cut_lineage(pairs.join(e, [*pk, "gt_id"]).select(*pk, "gt_id", "cost"))
            old = match.select(*pk, F.col("gt_id").alias("gt_old"))
            cursor = cut_lineage(now.select(*pk).join(old, pk).select("n", F.col("gt_old").alias("gt_id")))
            match = cut_lineage(match.join(now.select(*pk), pk, "left_anti").select(*pk, "gt_id", "cost").unionByName(now))
        waiting = cut_lineage(waiting.join(start, pk, "left_anti"))
    return preds.drop("mate").join(match.select(*pk, F.col("gt_id").alias("mate")), pk, "left")


#: Side of a merging tile in multiples of the merge distance, and objects that the tiles of one task hold together.
TILE_REACH, TILE_OBJECTS = 40, 50_000
OBJECT = ["cy", "cx", "y1", "x1", "y2", "x2", "area"]
MERGED = [f"m_{c}" for c in OBJECT]


def merge_in_view(rows: list[tuple], dist: float) -> list[tuple | None]:
    """What becomes of the objects of a tile and its rim, given in id order as (id, object, own, start, merged, n).

    ``start`` is the first object of the cluster that took the object, or None if that is not known; ``merged`` is the cluster's state from then on. An
    object joins the cluster of first start whose centroid lies within ``dist``, as of the objects before it, else it starts one. Own
    objects are decided unless an undecided earlier object lies within 3 ``dist``: closer ones decide about clusters that
    may take this one, and those at most 1.5 ``dist`` from these about whether such a cluster has moved on. Returns (start, merged, n)
    for newly decided objects, None for others.
    """
    cell = lambda y, x: (int(y // (3 * dist)), int(x // (3 * dist)))
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    open_: dict[tuple[int, int], list[tuple[float, float]]] = {}
    clusters: dict[tuple[int, int], dict] = {}  # the latest object of each cluster, by place: start -> (y, x, merged, n)
    latest: dict = {}
    out: list[tuple | None] = []
    for i, obj, own, start, merged, n in rows:
        y, x = obj[0], obj[1]
        r, c = cell(y, x)
        found = None
        if start is None:
            if not own or any(math.dist((y, x), o) < 3 * dist for a, b in around for o in open_.get((r + a, c + b), ())):
                open_.setdefault((r, c), []).append((y, x))
                out.append(None)
                continue
            near = [(s, m, k) for a, b in around for s, (m, k) in clusters.get((r + a, c + b), {}).items() if math.dist((y, x), m[:2]) < dist]
            if near:
                start, m, k = min(near, key=lambda t: t[0])
                merged = ((m[0] + y) / 2.0, (m[1] + x) / 2.0, min(m[2], obj[2]), min(m[3], obj[3]), max(m[4], obj[4]), max(m[5], obj[5]), m[6] + obj[6])
                n = k + 1
            else:
                start, merged, n = i, obj, 1
            found = (start, merged, n)
        if start in latest:
            del clusters[latest[start]][start]
        clusters.setdefault((r, c), {})[start] = (merged, n)
        latest[start] = (r, c)
        out.append(found)
    return out


def _merge_tiles(comp: list[str], dist: float, columns: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.sort_values("obj_id").groupby([*comp, "_ty", "_tx"], sort=False, dropna=False):
            rows = [
                (i, obj, own, start if known else None, merged, n)
                for i, obj, own, known, start, merged, n in zip(
                    part["obj_id"].tolist(), part[OBJECT].itertuples(index=False, name=None), part["own"].tolist(), part["known"].tolist(), part["start"].tolist(), part[MERGED].itertuples(index=False, name=None), part["n_merged"].tolist()
                )
            ]
            done = merge_in_view(rows, dist)
            at = [j for j, d in enumerate(done) if d is not None]
            if at:
                some = part.iloc[at].copy()
                some["start"], some["n_merged"], some["known"] = [done[j][0] for j in at], [done[j][2] for j in at], True
                some[MERGED] = [done[j][1] for j in at]
                out.append(some[columns])
        return pd.concat(out) if out else pdf.iloc[:0][columns]

    return run


def merge_by_tiles(objects: DataFrame, comp: list[str], dist: float, tile: float | None = None) -> DataFrame:
    """The greedy merge in id order for components of any size, many absorptions per round.

    The ordered pass is the same as visiting all objects once in id order, where each joins the cluster of first start that is near. So an
    object can be decided as soon as the earlier objects around it are. Tiles decide what they can with a rim of 3 ``dist`` in
    view; the next round has the undecided objects and the decided ones in their view.
    """
    side = float(tile or TILE_REACH * dist)
    kind = {f.name: f.dataType.simpleString() for f in objects.schema.fields}
    columns = [*comp, "obj_id", *OBJECT, "known", "start", *MERGED, "n_merged"]
    schema = ", ".join(f"`{k}` {kind[k]}" for k in [*comp, "obj_id"]) + "".join(f", {c} double" for c in OBJECT) + f", known boolean, start {kind['obj_id']}" + "".join(f", {c} double" for c in MERGED) + ", n_merged bigint"
    numbers = [F.col(c).cast("double").alias(c) for c in OBJECT]
    left = objects.select(*comp, "obj_id", *numbers, F.lit(False).alias("known"), F.col("obj_id").alias("start"), *[F.lit(0.0).alias(c) for c in MERGED], F.lit(0).cast("bigint").alias("n_merged"))
    left = cut_lineage(left)
    parts = [left.limit(0)]
    at = lambda c, d: F.floor((F.col(c) + F.lit(d)) / F.lit(side))
    reach = lambda c: F.explode(F.sequence(at(c, -3 * dist), at(c, 3 * dist)))
    n = left.count()
    while n:
        active = left.select(*comp, at("cy", 0).alias("_ty"), at("cx", 0).alias("_tx")).distinct()
        seen = reduce(DataFrame.unionByName, [left, *parts]).withColumn("_ty", reach("cy")).withColumn("_tx", reach("cx"))
        seen = join_keys(seen, active.withColumn("_on", F.lit(True)), [*comp, "_ty", "_tx"]).drop("_on").withColumn("own", (F.col("_ty") == at("cy", 0)) & (F.col("_tx") == at("cx", 0)))
        bins = max(1, -(-n // TILE_OBJECTS), min(n // 500, 64))
        news = cut_lineage(seen.withColumn("_bin", F.pmod(F.xxhash64(*comp, "_ty", "_tx"), F.lit(bins))).groupBy("_bin").applyInPandas(_merge_tiles(comp, dist, columns), schema))
        left = cut_lineage(join_keys(left, news.select(*comp, "obj_id", F.lit(True).alias("_now")), [*comp, "obj_id"], "left").where("_now is null").drop("_now"))
        parts.append(news)
        if len(parts) == 16:  # a plan of bounded size, however many rounds there are
            parts = [cut_lineage(reduce(DataFrame.unionByName, parts))]
        n = left.count()
    last = reduce(DataFrame.unionByName, parts).groupBy(*comp, "start").agg(F.max_by(F.struct(*MERGED, "n_merged"), "obj_id").alias("m"))
    return last.select(*comp, F.col("start").alias("obj_id"), *[F.col(f"m.m_{c}").cast(kind[c]).alias(c) for c in OBJECT], F.col("m.n_merged").alias("n_merged"))
