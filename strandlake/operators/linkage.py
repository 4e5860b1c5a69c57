"""Average linkage of frames whose distances no task could hold, in rounds: from the frames themselves (``linked_frames``, which keeps no distances), or over a
table of matrix rows (``average_linkage``).

Each cluster is a row of its mean distances to all clusters of its trajectory. In a round every row names its nearest, all pairs that name each other merge at
once (in average linkage a merger brings no two clusters closer than their nearest were, so the order does not matter), and rows and columns of a pair
become their mean weighted by size. A task holds a tile of some ``TILE_BYTES`` of rows; one number per cluster goes through the trajectory's task.

``linked_frames`` makes the same mergers and measures anew what a round needs: the mean distances of the clusters whose nearest is not known any more, because
they or it merged, to those that bounds from moments of the clusters leave (``kernels.clusters``). Tiles of clusters meet in pairs; a task sends each cluster's nearest. Some numbers per frame go through the trajectory's task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.kernels import clusters, linear
from strandlake.operators import chunks
from strandlake.session import materialize

TILE_BYTES = 16 << 20
ROW = "traj_id string, tile int, id int, n int, size long, row binary, members array<int>, nearest int, distance double"


def nearest_row(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, value) of each row's least entry, the first of equals."""
    at = rows.argmin(1)
    return at, rows[np.arange(len(rows)), at]


def mutual(nearest: np.ndarray, distance: np.ndarray, cutoff: float) -> np.ndarray:
    """For every cluster the one it becomes part of: of each pair that are each other's nearest within ``cutoff``, the first. If rounding of equal
    distances leaves no such pair, the closest pair merges."""
    own = np.arange(len(nearest))
    into = own.copy()
    if len(own) < 2:
        return into
    second = (nearest[nearest] == own) & (nearest < own) & (distance <= cutoff)
    into[second] = nearest[second]
    if not second.any() and distance.min() <= cutoff:
        i = int(distance.argmin())
        into[max(i, nearest[i])] = min(i, nearest[i])
    return into


def _table(traj: str, tile: int, ids, sizes, rows: np.ndarray, members) -> pa.Table:
    at, value = nearest_row(rows)
    k = len(rows)
    return pa.table(
        {
            "traj_id": pa.array([traj] * k, pa.string()),
            "tile": pa.array([tile] * k, pa.int32()),
            "id": pa.array(ids, pa.int32()),
            "n": pa.array([rows.shape[1]] * k, pa.int32()),
            "size": pa.array(sizes, pa.int64()),
            "row": pa.array([r.tobytes() for r in rows], pa.binary()),
            "members": pa.array(members, pa.list_(pa.int32())),
            "nearest": pa.array(at, pa.int32()),
            "distance": pa.array(value, pa.float64()),
        }
    )


def distance_rows(features: DataFrame, weights: dict[str, float], manhattan: tuple[str, ...] = (), tile_bytes: int = TILE_BYTES) -> DataFrame:
    """A row per frame: distances of every feature set over the trajectory's largest, blended by ``weights``. features: (traj_id, frame, an array per set).

    Tiles of frames meet all frames of their trajectory, twice: for the largest distances and for the rows."""
    per_tile = F.greatest(F.lit(1), F.floor(F.lit(tile_bytes / 8) / F.col("n")))
    placed = chunks.numbered(features, "traj_id", "frame").withColumn("per_tile", per_tile).select("traj_id", "frame", "i", "per_tile", "n", *weights)
    dealt = placed.withColumn("tile", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("per_tile")).cast("int"))))

    def sets(t: pa.Table):
        t = t.sort_by("i")
        own = np.flatnonzero(t["i"].to_numpy() // t["per_tile"].to_numpy() == t["tile"][0].as_py())
        for name in weights:
            x = np.array(t[name].to_pylist(), float).reshape(t.num_rows, -1)
            yield name, own, linear.distances(x, manhattan=name in manhattan, of=own)

    def largest(t: pa.Table) -> pa.Table:
        return pa.table({"traj_id": t["traj_id"].slice(0, 1)} | {f"{name}_peak": [float(d.max(initial=0.0))] for name, _, d in sets(t)})

    peaks = dealt.groupBy("traj_id", "tile").applyInArrow(largest, "traj_id string, " + ", ".join(f"{name}_peak double" for name in weights))
    peaks = peaks.groupBy("traj_id").agg(*(F.max(f"{name}_peak").alias(f"{name}_peak") for name in weights))

    def rows(t: pa.Table) -> pa.Table:
        total = 0.0
        for name, own, d in sets(t):
            peak = t[f"{name}_peak"][0].as_py()
            total = total + weights[name] * (d / peak if peak > 0 else d)
        total[np.arange(len(own)), own] = np.inf
        frames = t.sort_by("i")["frame"].to_numpy()[own]
        return _table(t["traj_id"][0].as_py(), t["tile"][0].as_py(), own, np.ones(len(own), int), total, [[f] for f in frames])

    return dealt.join(peaks, "traj_id").groupBy("traj_id", "tile").applyInArrow(rows, ROW)


def merged(state: DataFrame, into: DataFrame, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The rows after a round. into: (traj_id, tile, to, share, n_new), of every old cluster its new number and its part of the new one's size, for each tile of rows."""

    def shrink(rows: pa.Table, plan: pa.Table) -> pa.Table:
        if not rows.num_rows or not plan.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _parts})
        to, share = np.frombuffer(plan["to"][0].as_py(), np.int32), np.frombuffer(plan["share"][0].as_py(), float)
        n, ids = plan["n_new"][0].as_py(), rows["id"].to_numpy()
        per_tile = max(1, tile_bytes // 8 // n)
        # a row's own entry has no bound and stays so through every sum
        out = [(np.bincount(to, np.frombuffer(r.as_py(), float) * share, n) * share[i]).tobytes() for r, i in zip(rows["row"], ids)]
        return pa.table({"traj_id": rows["traj_id"], "tile": pa.array(to[ids] // per_tile, pa.int32()), "id": pa.array(to[ids], pa.int32()), "size": rows["size"], "row": pa.array(out, pa.binary()), "members": rows["members"]}).cast(_parts)

    def gather(t: pa.Table) -> pa.Table:
        ids, which = np.unique(t["id"].to_numpy(), return_inverse=True)
        rows = np.zeros((len(ids), len(t["row"][0].as_py()) // 8))
        members: list[list[int]] = [[] for _ in ids]
        for k, r, m in zip(which, t["row"], t["members"].to_pylist()):
            rows[k] += np.frombuffer(r.as_py(), float)
            members[k] += m
        return _table(t["traj_id"][0].as_py(), t["tile"][0].as_py(), ids, np.bincount(which, t["size"].to_numpy()).astype(int), rows, members)

    sides = into.select(F.col("traj_id").alias("of"), F.col("tile").alias("at"), "to", "share", "n_new")
    parts = state.groupBy("traj_id", "tile").cogroup(sides.groupBy("of", "at")).applyInArrow(shrink, "traj_id string, tile int, id int, size long, row binary, members array<int>")
    return parts.groupBy("traj_id", "tile").applyInArrow(gather, ROW)


#: Frames of a tile of clusters at least, tiles of a trajectory while they hold no more than the third, and clusters whose matrix is one task's.
TILE_FRAMES, TILES, MOST, FEW = 2048, 8, 65536, 6000
_PLAN = "traj_id string, label array<int>, tile array<int>, tiles int, stale int, last boolean, nearest array<int>, distance array<double>"


def _set(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)


def _by_cluster(t: pa.Table, tile: str, sets: list[str]) -> tuple[np.ndarray, clusters.Side]:
    """The clusters of one side of a pair of tiles, and their frames."""
    side = t.filter(pc.equal(t["tile"], t[tile])).sort_by([("label", "ascending"), ("i", "ascending")])
    ids, starts, sizes = np.unique(side["label"].to_numpy(), return_index=True, return_counts=True)
    return ids, clusters.Side(np.concatenate([_set(side, name) for name in sets], axis=1), starts, sizes)


def linked_frames(
    features: DataFrame, weights: dict[str, float], cutoff: float, manhattan: tuple[str, ...] = (), tile_frames: int = TILE_FRAMES, few: int = FEW
) -> DataFrame:
    """(traj_id, frame, cluster) of average linkage cut at ``cutoff``, clusters numbered from 0 by their first frame. features: (traj_id, frame, an array per set); a
    distance is each set's over the trajectory's largest, blended by ``weights``.

    Equal frames are one cluster from the start. A cluster farther than ``cutoff`` from all others takes no further part: mergers bring nothing nearer to it. A trajectory of at most ``few``
    clusters that may still merge ends in one task. What a round writes are some numbers a frame; it sends a frame to some ``TILES`` tasks, which measure the pairs of clusters that bounds leave."""
    frames = materialize(chunks.numbered(features, "traj_id", "frame").select("traj_id", "frame", F.col("i").cast("int").alias("i"), "n", *weights), "frames")

    def per_tile(n: int) -> int:
        return max(tile_frames, min(-(-n // TILES), MOST))

    def pairs(placed: DataFrame, number: int) -> DataFrame:
        """Frames dealt to the pairs of tiles a <= b with a below ``stale``, in ``number`` partitions or some for each core."""
        other = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.least(o, "tile") < F.col("stale"))
        met = placed.where("tile >= 0").withColumn("_o", F.explode(other))
        met = met.withColumns({"a": F.least("_o", "tile"), "b": F.greatest("_o", "tile")}).drop("_o")
        return met.repartition(max(1, min(number, 6 * features.sparkSession.sparkContext.defaultParallelism)), "traj_id", "a", "b")

    count = F.sum(F.expr("stale * (2 * tiles - stale + 1) div 2"))
    per = F.greatest(F.lit(tile_frames), F.least(F.ceil(F.col("n") / TILES), F.lit(MOST)))
    start = frames.withColumns({"label": F.col("i"), "tile": F.floor(F.col("i") / per).cast("int"), "tiles": F.ceil(F.col("n") / per).cast("int"), "stale": F.ceil(F.col("n") / per).cast("int")})

    def largest(t: pa.Table) -> pa.Table:
        one, two = (t.filter(pc.equal(t["tile"], t[side])) for side in "ab")
        return pa.table({"traj_id": t["traj_id"].slice(0, 1)} | {f"{name}_peak": [clusters.largest(_set(one, name), _set(two, name), name in manhattan)] for name in weights})

    number = start.where("i = 0").agg(count).first()[0] or 0
    peaks = pairs(start, number).groupBy("traj_id", "a", "b").applyInArrow(largest, "traj_id string, " + ", ".join(f"{name}_peak double" for name in weights))
    peaks = materialize(peaks.groupBy("traj_id").agg(*(F.max(f"{name}_peak").alias(f"{name}_peak") for name in weights)), "peaks")

    def sides(t: pa.Table) -> tuple:
        """Both sides of a pair of tiles, and their feature sets."""
        (rows, one), (columns, two) = (_by_cluster(t, side, list(weights)) for side in "ab")
        sets, at = [], 0
        for name, weight in weights.items():
            width = len(t[name][0])
            sets.append(clusters.Set(slice(at, at + width), weight, t[f"{name}_peak"][0].as_py(), name in manhattan))
            at += width
        return rows, one, columns, two, sets

    def means(t: pa.Table):
        """The clusters of both sides and their mean distances; a cluster's own has no bound."""
        rows, one, columns, two, sets = sides(t)
        total = np.zeros((len(rows), len(columns)))
        if not total.size:
            return rows, columns, total
        at = np.repeat(np.arange(len(rows)), one.sizes)
        for first, d in clusters.distance_blocks(one.x, two.x, sets):
            which = at[first : first + len(d)]
            cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            d = d if len(columns) == len(two.x) else np.add.reduceat(d, two.starts, axis=1)
            total[which[cut]] += d if len(cut) == len(d) else np.add.reduceat(d, cut, axis=0)
        total /= one.sizes[:, None]
        total /= two.sizes
        if t["a"][0].as_py() == t["b"][0].as_py():
            np.fill_diagonal(total, np.inf)
        return rows, columns, total

    def nearest(t: pa.Table) -> pa.Table:
        rows, one, columns, two, sets = sides(t)
        a, b, stale = (t[c][0].as_py() for c in ("a", "b", "stale"))
        found = clusters.nearest(one, two, sets, cutoff, a == b, a < b < stale)
        known = [(i[of], k[other], value) for (i, k), (of, other, value) in zip(((rows, columns), (columns, rows)), found)]
        of, other, value = (np.concatenate([np.zeros(0), *(x[k] for x in known)]) for k in range(3))
        head = pa.array([t["traj_id"][0].as_py()] * len(of), pa.string())
        return pa.table({"traj_id": head, "id": pa.array(of.astype(np.int32)), "nearest": pa.array(other.astype(np.int32)), "distance": pa.array(value)})

    def deal(size: np.ndarray, lost: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, int, int]:
        """The tile of each cluster, -1 where it takes no part, those of the ``lost`` first; all tiles, and theirs."""
        tile, done, stale, per = np.full(len(size), -1), 0, 0, per_tile(int(size[alive].sum()))
        for part in (lost, alive & ~lost):
            ids = np.flatnonzero(part)
            if len(ids):
                number = np.unique((np.cumsum(size[ids]) - size[ids]) // per, return_inverse=True)[1]
                tile[ids] = done + number
                done += int(number[-1]) + 1
            if part is lost:
                stale = done
        return tile, done, stale

    def plan(label: np.ndarray, near: np.ndarray, distance: np.ndarray) -> tuple:
        """One round: mergers, and what is to be measured for the next."""
        into = mutual(near, distance, cutoff)
        kept, to = np.unique(into, return_inverse=True)
        label, grown = to[label], np.bincount(to) > 1
        near, distance = to[near[kept]], distance[kept]
        lost = grown | (grown[near] & (distance <= cutoff))
        alive = lost | (distance <= cutoff)
        last = bool(lost.any()) and alive.sum() <= few
        if last:
            lost = alive.copy()
        elif not lost.any():
            alive[:] = False
        tile, tiles, stale = deal(np.bincount(label), lost, alive)
        return label, tile[label], tiles, stale, last, near, np.where(lost, np.inf, distance)

    def row(traj: str, label, tile, tiles, stale, last, near, distance) -> pa.Table:
        ints = pa.list_(pa.int32())
        return pa.table(
            {
                "traj_id": pa.array([traj], pa.string()),
                "label": pa.array([label.astype(np.int32)], ints),
                "tile": pa.array([tile.astype(np.int32)], ints),
                "tiles": pa.array([tiles], pa.int32()),
                "stale": pa.array([stale], pa.int32()),
                "last": pa.array([last], pa.bool_()),
                "nearest": pa.array([near.astype(np.int32)], ints),
                "distance": pa.array([distance], pa.list_(pa.float64())),
            }
        )

    def found_nearest(found: pa.Table, near: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, other, value = (found[c].to_numpy() for c in ("id", "nearest", "distance"))
        order = np.lexsort((other, value, ids))
        ids, first = np.unique(ids[order], return_index=True)
        near, distance = near.copy(), distance.copy()
        near[ids], distance[ids] = other[order][first], value[order][first]
        return near, distance

    def begin(t: pa.Table) -> pa.Table:
        """Every frame a cluster, or the equal ones; all are to be measured."""
        label = np.unique(t.sort_by("i")["first"].to_numpy(), return_inverse=True)[1]
        size = np.bincount(label)
        every = np.full(len(size), len(size) > 1)
        tile, tiles, stale = deal(size, every, every)
        return row(t["traj_id"][0].as_py(), label, tile[label], tiles, stale, bool(every.any()) and len(size) <= few, np.arange(len(size)), np.full(len(size), np.inf))

    def go_on(state: pa.Table, found: pa.Table) -> pa.Table:
        label, near, distance = (state[c][0].values.to_numpy() for c in ("label", "nearest", "distance"))
        return row(state["traj_id"][0].as_py(), *plan(label, *found_nearest(found, near, distance)))

    def blocks_of(t: pa.Table) -> pa.Table:
        rows, columns, d = means(t)
        return pa.table({"traj_id": t["traj_id"].slice(0, 1), "rows": pa.array([rows], pa.list_(pa.int32())), "columns": pa.array([columns], pa.list_(pa.int32())), "d": pa.array([d.tobytes()], pa.binary())})

    def finish(state: pa.Table, found: pa.Table) -> pa.Table:
        """Link the clusters that may still merge by their matrix."""
        label = state["label"][0].values.to_numpy()
        size = np.bincount(label)
        ids = np.unique(np.concatenate([r.values.to_numpy() for r in found["rows"]] + [np.zeros(0, np.int32)]))
        d = np.full((len(ids),) * 2, np.inf)
        for r, c, m in zip(found["rows"], found["columns"], found["d"]):
            r, c = (np.searchsorted(ids, v.values.to_numpy()) for v in (r, c))
            m = np.frombuffer(m.as_buffer(), float).reshape(len(r), -1)
            d[np.ix_(r, c)] = m
            d[np.ix_(c, r)] = m.T
        to = np.arange(len(size))
        if len(ids) > 1:
            linked = linear.average_linkage(d, cutoff, size[ids])
            to[ids] = ids[np.unique(linked, return_index=True)[1]][linked]
        nothing = np.zeros(0, int)
        return row(state["traj_id"][0].as_py(), to[label], np.full(len(label), -1), 0, 0, False, nothing, nothing.astype(float))

    def measured(placed: DataFrame, number: int, how, schema: str) -> DataFrame:
        return pairs(placed.join(F.broadcast(peaks), "traj_id"), number).groupBy("traj_id", "a", "b").applyInArrow(how, schema)

    near_kind = "traj_id string, id int, nearest int, distance double"
    equal = frames.groupBy("traj_id", *weights).agg(F.min("i").alias("_first"), F.count("*").alias("_k")).where(F.col("_k") > 1).where(F.lit(cutoff >= 0))
    firsts = frames.join(equal, ["traj_id", *weights], "left").select("traj_id", "i", F.coalesce("_first", "i").alias("first"))
    state = firsts.groupBy("traj_id").applyInArrow(begin, _PLAN)
    done = []
    while True:
        state = materialize(state, "linkage")
        done.append(state.where("stale = 0").select("traj_id", "label"))
        left = dict(state.where("stale > 0").groupBy("last").agg(count).collect())  # two rows at most
        if not left:
            break
        placed = state.select("traj_id", F.inline(F.arrays_zip(F.expr("sequence(0, size(label) - 1)").alias("i"), "label", "tile")), "tiles", "stale", "last")
        placed = frames.join(placed, ["traj_id", "i"])
        rounds = []
        if False in left:
            found = measured(placed.where("NOT last"), left[False], nearest, near_kind)
            rounds.append(state.where("stale > 0 AND NOT last").groupBy("traj_id").cogroup(found.groupBy("traj_id")).applyInArrow(go_on, _PLAN))
        if True in left:
            found = measured(placed.where("last"), left[True], blocks_of, "traj_id string, rows array<int>, columns array<int>, d binary")
            rounds.append(state.where("stale > 0 AND last").groupBy("traj_id").cogroup(found.groupBy("traj_id")).applyInArrow(finish, _PLAN))
        state = rounds[0] if len(rounds) == 1 else rounds[0].unionByName(rounds[1])
    labels = done[0]
    for more in done[1:]:
        labels = labels.unionByName(more)
    numbers = labels.select("traj_id", F.posexplode("label").alias("i", "label"))
    first = numbers.groupBy("traj_id", "label").agg(F.min("i").alias("first"))
    first = chunks.numbered(first, "traj_id", "first").select("traj_id", "label", F.col("i").cast("int").alias("cluster"))
    return frames.select("traj_id", "frame", "i").join(numbers, ["traj_id", "i"]).join(first, ["traj_id", "label"]).select("traj_id", "frame", "cluster")


_parts = pa.schema([("traj_id", pa.string()), ("tile", pa.int32()), ("id", pa.int32()), ("size", pa.int64()), ("row", pa.binary()), ("members", pa.list_(pa.int32()))])


def average_linkage(rows: DataFrame, cutoff: float, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(traj_id, frame, cluster) of average linkage cut at ``cutoff``, clusters numbered from 0 by their first frame. rows: as ``distance_rows`` makes them.

    Every round is written to the shared folder; a trajectory leaves the rounds when nothing in it merges. The driver reads one count a round."""

    def plan(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        size = t["size"].to_numpy()
        first = mutual(t["nearest"].to_numpy(), t["distance"].to_numpy(), cutoff)
        kept, to = np.unique(first, return_inverse=True)
        share = size / np.bincount(to, size)[to]
        return pa.table({"traj_id": t["traj_id"].slice(0, 1), "to": pa.array([to.astype(np.int32).tobytes()], pa.binary()), "share": pa.array([share.tobytes()], pa.binary()), "n_new": pa.array([len(kept)], pa.int32()), "n_old": pa.array([len(size)], pa.int32())})

    state, done = materialize(rows, "linkage"), []
    while True:
        plans = state.select("traj_id", "id", "size", "nearest", "distance").groupBy("traj_id").applyInArrow(plan, "traj_id string, to binary, share binary, n_new int, n_old int")
        plans = materialize(plans, "mergers")
        rest = plans.where("n_new < n_old")
        done.append(state.select("traj_id", "members").join(rest.select("traj_id"), "traj_id", "left_anti"))
        if not rest.count():
            break
        tiles = state.select("traj_id", "tile").distinct()
        state = materialize(merged(state, tiles.join(rest, "traj_id").drop("n_old"), tile_bytes), "linkage")
    linked = done[0]
    for more in done[1:]:
        linked = linked.unionByName(more)
    first = chunks.numbered(linked.withColumn("first", F.array_min("members")), "traj_id", "first")
    return first.select("traj_id", F.explode("members").alias("frame"), F.col("i").cast("int").alias("cluster"))
