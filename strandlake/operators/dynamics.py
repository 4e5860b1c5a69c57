"""Collective motion: correlations, modes, medoids, frame clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.kernels import linear
from strandlake.operators import linkage, moments
from strandlake.operators.geometry import stack
from strandlake.session import materialize


def _axis_moments(frames: DataFrame) -> DataFrame:
    """``second_moments`` of the coordinates along each axis; keys are the axis, a slash, the trajectory."""
    axis = lambda k: F.struct(F.lit(k).alias("axis"), F.filter("xyz", lambda _, i: i % 3 == k).alias("vector"))
    rows = frames.select("traj_id", F.inline(F.array(*map(axis, range(3))))).select(F.concat_ws("/", F.col("axis").cast("string"), "traj_id").alias("key"), "vector")
    return moments.second_moments(rows, "key", "vector")


def cross_correlation(frames: DataFrame) -> DataFrame:
    """(traj_id, i, j, cov, v): covariance of atom displacements summed over the axes, and the correlation clipped to [-1, 1], i <= j, of dense
    frames (traj_id, frame, xyz) as they lie (superposed before, if wanted). Atoms are numbered by their place."""
    cov = moments.covariances(_axis_moments(frames), "key").where("a <= b")
    pairs = cov.groupBy(F.expr("substring(key, 3)").alias("traj_id"), F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("cov").alias("cov"))
    own = pairs.where("i = j")
    out = pairs.join(own.select("traj_id", "i", F.col("cov").alias("vi")), ["traj_id", "i"]).join(own.select("traj_id", F.col("i").alias("j"), F.col("cov").alias("vj")), ["traj_id", "j"])
    norm = F.sqrt(F.col("vi") * F.col("vj"))
    return out.select("traj_id", "i", "j", "cov", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.when(norm == 0, 1.0).otherwise(norm))).alias("v"))


def block_coupling(correlation: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mean absolute correlation between blocks of atoms (atom_id, block), i < j."""
    one = blocks.select(F.col("atom_id").alias("i"), F.col("block").alias("b1"))
    two = blocks.select(F.col("atom_id").alias("j"), F.col("block").alias("b2"))
    j = correlation.where("i < j").join(one, "i").join(two, "j")
    return j.groupBy("traj_id", F.least("b1", "b2").alias("block_1"), F.greatest("b1", "b2").alias("block_2")).agg(F.avg(F.abs("v")).alias("coupling"), F.count("*").alias("n_pairs"))


def superposed(frames: DataFrame, reference: int = 0) -> DataFrame:
    """(traj_id, frame, xyz) with every frame superposed onto its trajectory's reference frame, where it is read: written out first, the references
    have a known size, and Spark broadcasts them up to its threshold instead of moving all frames."""
    ref = materialize(frames.where(F.col("frame") == reference).select("traj_id", F.col("xyz").alias("ref")), "references")

    def fit(batches):
        for b in batches:
            sizes = pc.list_value_length(b["xyz"]).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):  # trajectories may differ in atoms
                part = b.filter(pa.array(sizes == n))
                y = linear.superpose_each(stack(part["xyz"]), stack(part["ref"])).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part["traj_id"], part["frame"], pa.array(list(y), pa.list_(pa.float64()))], ["traj_id", "frame", "xyz"])

    return frames.join(ref, "traj_id").select("traj_id", "frame", "xyz", "ref").mapInArrow(fit, "traj_id string, frame int, xyz array<double>")


def collective_modes(frames: DataFrame) -> DataFrame:
    """Modes that hold nine tenths of the variance, and collectivity, of the atom covariance (summed over the axes) of each trajectory's dense frames as they lie.

    The sums of partial matrices meet in the trajectory's task; no row per pair of atoms is made."""
    sums = _axis_moments(frames).withColumn("traj_id", F.expr("substring(key, 3)"))

    def modes(t: pa.Table) -> pa.Table:
        keys = np.array(t["key"].to_pylist(), object)
        cov = sum(moments.matrix_of(t.filter(pa.array(keys == k)))[2] for k in dict.fromkeys(keys))
        n, spread = linear.spectrum(np.linalg.eigvalsh(cov))
        return pa.table({"traj_id": t["traj_id"].slice(0, 1), "n_modes_90": pa.array([n], pa.int32()), "collectivity": [spread / len(cov)], "trace": [float(np.trace(cov))]})

    return sums.groupBy("traj_id").applyInArrow(modes, "traj_id string, n_modes_90 int, collectivity double, trace double")


_MODES = "traj_id string, variance_share double, cosine_content double, n_atoms int, modes array<double>"


def _content(p: np.ndarray) -> float | None:
    """Likeness of a projection, in order of time, to half a cosine period."""
    wave = np.cos(np.pi * np.arange(len(p)) / len(p)) @ p
    return float(2 / len(p) * wave * wave / (p @ p)) if p.any() else None


def _spectrum_of(gram: np.ndarray, n_modes: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of the first, eigenvalues, eigenvectors) of the leading modes of a matrix of inner products."""
    w, u = np.linalg.eigh(gram)
    w, u = np.maximum(w[::-1], 0), u[:, ::-1]
    k = min(n_modes, int((w > 1e-10 * max(w[0], 1e-300)).sum()))
    return (float(w[0] / w.sum()) if w.sum() > 0 else 0.0), w[: max(k, 1)], u[:, : max(k, 1)] if k else np.zeros((len(w), 1))


def _modes_row(traj: pa.ChunkedArray, share: float, content: float | None, n_atoms: int, modes: np.ndarray) -> pa.Table:
    return pa.table(
        {"traj_id": traj.slice(0, 1), "variance_share": [share], "cosine_content": pa.array([content], pa.float64()), "n_atoms": pa.array([n_atoms], pa.int32()), "modes": pa.array([modes.ravel()], pa.list_(pa.float64()))}
    )


def _modes_from_frames(fitted: DataFrame, n_modes: int) -> DataFrame:
    """Modes of trajectories that fit a task, from the inner products of their frames: each frame moves once, no matrix does."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        x = stack(t["xyz"]).reshape(t.num_rows, -1)
        x = x - x.mean(0)
        share, w, u = _spectrum_of(x @ x.T, n_modes)
        keep = u.any(0)
        return _modes_row(t["traj_id"], share, _content(u[:, 0] * np.sqrt(w[0])), x.shape[1] // 3, (u[:, keep].T @ x) / np.sqrt(w[keep])[:, None])

    return fitted.groupBy("traj_id").applyInArrow(run, _MODES)


def _modes_from_tiles(placed: DataFrame, fitted: DataFrame, n_modes: int, rows: int = 400) -> DataFrame:
    """The same from tiles of frames (``tiles`` of them): each pair of tiles is a task that sends its inner products, the trajectory's task decomposes these, and
    a second pass adds the frames up with the weights that it gives them."""
    dealt = placed.withColumn("a", F.expr("cast(pmod(xxhash64(frame), tiles) as int)")).withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)")))
    pairs = dealt.select("traj_id", F.col("a").alias("own"), F.least("a", "o").alias("a"), F.greatest("a", "o").alias("b"), "frame", "xyz")
    ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())

    def products(t: pa.Table) -> pa.Table:
        own, frame, x = t["own"].to_numpy(), t["frame"].to_numpy(), stack(t["xyz"]).reshape(t.num_rows, -1)
        one, two = np.flatnonzero(own == t["a"][0].as_py()), np.flatnonzero(own == t["b"][0].as_py())
        out = [(frame[one[i : i + rows]], frame[two], (x[one[i : i + rows]] @ x[two].T).ravel()) for i in range(0, len(one), rows) if len(two)]
        head = pa.chunked_array([t["traj_id"].slice(0, 1).combine_chunks().take(pa.array([0] * len(out), pa.int64()))])
        return pa.table({"traj_id": head, "rows": pa.array([r[0] for r in out], ints), "columns": pa.array([r[1] for r in out], ints), "g": pa.array([r[2] for r in out], doubles)})

    def weigh(t: pa.Table) -> pa.Table:
        parts = [tuple(t[c][i].values.to_numpy() for c in ("rows", "columns", "g")) for i in range(t.num_rows)]
        frame = np.unique(np.concatenate([p[0] for p in parts] + [p[1] for p in parts]))
        gram = np.zeros((len(frame),) * 2)
        for r, c, g in parts:
            i, j, g = np.searchsorted(frame, r), np.searchsorted(frame, c), g.reshape(len(r), -1)
            gram[np.ix_(i, j)] = g
            gram[np.ix_(j, i)] = g.T
        mean = gram.mean(0)
        share, w, u = _spectrum_of(gram - mean - mean[:, None] + mean.mean(), n_modes)
        keep = u.any(0)
        weights = u[:, keep] / np.sqrt(w[keep])  # they sum to zero over the frames, so these need not be centred
        n = len(frame)
        return pa.table(
            {"traj_id": t["traj_id"].slice(0, 1).combine_chunks().take(pa.array([0] * n, pa.int64())), "frame": pa.array(frame, pa.int32()), "share": [share] * n, "content": pa.array([_content(u[:, 0] * np.sqrt(w[0]))] * n, pa.float64()), "w": pa.array(list(weights), doubles)}
        )

    blocks = pairs.groupBy("traj_id", "a", "b").applyInArrow(products, "traj_id string, rows array<int>, columns array<int>, g array<double>")
    weights = materialize(blocks.groupBy("traj_id").applyInArrow(weigh, "traj_id string, frame int, share double, content double, w array<double>"), "weights")

    def partial(batches):
        for b in batches:
            ids = np.array(b["traj_id"].to_pylist(), object)
            for t in dict.fromkeys(ids):
                part = b.filter(pa.array(ids == t))
                w, x = np.array(part["w"].to_pylist(), float).reshape(part.num_rows, -1), stack(part["xyz"]).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(part[c].slice(0, 1) for c in ("traj_id", "share", "content")), pa.array([x.shape[1] // 3], pa.int32()), pa.array([(w.T @ x).ravel()], doubles)], ["traj_id", "share", "content", "n_atoms", "modes"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([m.values.to_numpy() for m in t["modes"]], axis=0)
        return _modes_row(t["traj_id"], t["share"][0].as_py(), t["content"][0].as_py(), t["n_atoms"][0].as_py(), total)

    sums = fitted.join(weights, ["traj_id", "frame"]).select("traj_id", "share", "content", "w", "xyz").mapInArrow(partial, "traj_id string, share double, content double, n_atoms int, modes array<double>")
    return sums.groupBy("traj_id").applyInArrow(add, _MODES)


def _modes_from_covariance(fitted: DataFrame, n_modes: int) -> DataFrame:
    """Modes of trajectories of more frames than coordinates: their covariance is summed by Spark and a trajectory's task decomposes that matrix alone."""
    sums = moments.second_moments(fitted.select("traj_id", "xyz"), "traj_id", "xyz")

    def decompose(t: pa.Table) -> pa.Table:
        _, mean, cov = moments.matrix_of(t)
        share, w, v = _spectrum_of(cov, n_modes)
        doubles = pa.list_(pa.float64())
        return pa.table(
            {"traj_id": t["traj_id"].slice(0, 1), "variance_share": [share], "n_atoms": pa.array([len(mean) // 3], pa.int32()), "mean": pa.array([mean], doubles), "lead": pa.array([v[:, 0]], doubles), "modes": pa.array([v[:, v.any(0)].T.ravel()], doubles)}
        )

    modes = materialize(sums.groupBy("traj_id").applyInArrow(decompose, "traj_id string, variance_share double, n_atoms int, mean array<double>, lead array<double>, modes array<double>"), "modes")
    move = F.aggregate(F.zip_with(F.zip_with("xyz", "mean", lambda x, m: x - m), "lead", lambda d, v: d * v), F.lit(0.0), lambda a, x: a + x)
    moves = fitted.join(modes.select("traj_id", "mean", "lead"), "traj_id").select("traj_id", "frame", move.alias("p"))
    w = W.partitionBy("traj_id")
    moves = moves.withColumns({"t": F.row_number().over(w.orderBy("frame")) - 1, "n": F.count("*").over(w)})
    wave = F.sum(F.cos(F.lit(np.pi) * F.col("t") / F.col("n")) * F.col("p"))
    content = moves.groupBy("traj_id").agg((F.lit(2.0) / F.max("n") * wave * wave / F.nullif(F.sum(F.col("p") * F.col("p")), F.lit(0.0))).alias("cosine_content"))
    return modes.join(content, "traj_id").select("traj_id", "variance_share", "cosine_content", "n_atoms", "modes")


def essential_dynamics(frames: DataFrame, n_modes: int = 10, tile_bytes: int = 64 << 20, most: int = 8000) -> DataFrame:
    """First component's share and cosine content (likeness of the projection in time to half a cosine period), and the leading modes as flat arrays.

    Frames are superposed where they lie. A trajectory of fewer frames than coordinates is decomposed by the inner products of its frames: in one task if its frames take
    at most ``tile_bytes``, else by pairs of tiles of that size; the matrix of inner products of more than ``most`` frames is an error. One of more frames than coordinates is decomposed by its covariance."""
    fitted = materialize(superposed(frames), "fitted")
    shape = fitted.groupBy("traj_id").agg(F.count("*").alias("n"), F.max(F.size("xyz")).alias("d"))
    tiles = F.ceil(F.col("n") * F.col("d") * 8 / tile_bytes).cast("int")
    form = F.when(F.col("n") >= F.col("d"), 0).when(tiles <= 1, 1).when(F.col("n") <= most, 2).otherwise(F.raise_error(F.concat(F.lit("too many frames for their inner products: "), "traj_id")).cast("int"))
    shape = materialize(shape.select("traj_id", tiles.alias("tiles"), form.alias("form")), "shapes")
    of = lambda k: fitted.join(shape.where(F.col("form") == k).select("traj_id", "tiles"), "traj_id")
    present = {r.form for r in shape.select("form").distinct().collect()}
    parts = []
    if 0 in present or not present:
        parts.append(_modes_from_covariance(of(0).drop("tiles"), n_modes))
    if 1 in present:
        parts.append(_modes_from_frames(of(1).drop("tiles"), n_modes))
    if 2 in present:
        parts.append(_modes_from_tiles(of(2), fitted, n_modes))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subspace_overlap(modes: DataFrame, key: str) -> DataFrame:
    """Root mean square inner product of the modes of each pair of replicas of one ``key`` with equal atoms, averaged per replica. Where one has
    fewer modes, that many of the other's count."""
    a = modes.select(key, "n_atoms", F.col("traj_id").alias("t1"), F.col("modes").alias("m1"))
    b = modes.select(key, "n_atoms", F.col("traj_id").alias("t2"), F.col("modes").alias("m2"))
    pairs = a.join(b, [key, "n_atoms"]).where("t1 < t2")

    def run(batches):
        for r in batches:
            out = []
            for n, m1, m2 in zip(r["n_atoms"].to_pylist(), r["m1"], r["m2"]):
                x, y = (m.values.to_numpy().reshape(-1, 3 * n) for m in (m1, m2))
                k = min(len(x), len(y))
                out.append(float(np.sqrt(((x[:k] @ y[:k].T) ** 2).sum() / k)) if k else 0.0)
            yield pa.RecordBatch.from_arrays([r["t1"], r["t2"], pa.array(out, pa.float64())], ["t1", "t2", "rmsip"])

    both = pairs.select("t1", "t2", "n_atoms", "m1", "m2").mapInArrow(run, "t1 string, t2 string, rmsip double")
    return both.select(F.explode(F.array("t1", "t2")).alias("traj_id"), "rmsip").groupBy("traj_id").agg(F.avg("rmsip").alias("rmsip"), F.count("*").alias("n_compared"))


def _meetings(reps: DataFrame, group: str, tile: int, tiles: int, most: int) -> DataFrame:
    """Frames (group, traj_id, frame, xyz, w, wanted) dealt to the pairs of tiles that they meet in, those of the wanted frames with all: own, a <= b, wanted tiles first. Tiles hold ``tile`` frames at least; there are ``tiles`` of
    them at most, of either kind, while one does not hold more than ``most``, so a frame is sent that many times, however many frames there are."""
    cut = lambda n: F.greatest(F.least(F.ceil(n / tile), F.lit(tiles)), F.ceil(n / most)).cast("int")
    n = F.count_if("wanted")
    sizes = materialize(reps.groupBy(group).agg(cut(n).alias("k"), cut(F.count("*") - n).alias("rest")), "tiles")  # of a known size, so frames need not move by group
    placed = reps.join(sizes, group).withColumn("own", F.expr("cast(if(wanted, pmod(xxhash64(traj_id, frame), k), k + pmod(xxhash64(traj_id, frame), rest)) as int)"))
    met = placed.withColumn("o", F.explode(F.expr("filter(sequence(0, k + rest - 1), o -> least(o, own) < k)")))
    tasks = sizes.agg(F.sum(F.expr("k * (k + 1) / 2 + k * rest"))).first()[0] or 1
    return met.select(group, "own", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), "traj_id", "frame", "xyz", "w", "wanted").repartition(max(1, int(min(tasks, 2000))), group, "a", "b")


def _distinct(frames: DataFrame, group: str) -> DataFrame:
    """(group, traj_id, xyz, frame, w, equal): equal frames of a trajectory once, by their first, with their number and all of them. Groups whose atom numbers differ keep their first trajectory only."""
    shape = frames.withColumn("_n", F.size("xyz"))
    bad = shape.groupBy(group).agg(F.countDistinct("_n").alias("k"), F.min("traj_id").alias("first"))
    kept = shape.join(bad, group).where((F.col("k") == 1) | (F.col("traj_id") == F.col("first"))).drop("_n", "k", "first")
    return materialize(kept.groupBy(group, "traj_id", "xyz").agg(F.min("frame").alias("frame"), F.count("*").alias("w"), F.collect_list("frame").alias("equal")), "frames")


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Coordinates of a pair of tiles, the places of each tile's frames, and whether they are two."""
    own, a, b = t["own"].to_numpy(), t["a"][0].as_py(), t["b"][0].as_py()
    return stack(t["xyz"]), np.flatnonzero(own == a), np.flatnonzero(own == b), a != b


def _mean_rmsd(reps: DataFrame, group: str, tile: int, tiles: int, most: int) -> DataFrame:
    """(group, traj_id, frame, mean_rmsd, own_mean_rmsd) of the frames (group, traj_id, xyz, frame, w, wanted) that are wanted, to all of their group."""
    kind = reps.schema[group].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("traj_id")
        (x, first, second, two), w = _sides(t), t["w"].to_numpy().astype(float)
        wanted = t["wanted"].to_numpy(zero_copy_only=False)
        traj = np.unique(np.array(t["traj_id"].to_pylist(), object), return_inverse=True)[1] if t.num_rows else np.zeros(0, int)
        all_, same = np.zeros(len(w)), np.zeros(len(w))

        def add(d: np.ndarray, to: np.ndarray, of: np.ndarray) -> None:
            of_traj = np.unique(traj[of])  # a few: frames are in order of trajectories
            sums = d @ (w[of][:, None] * (traj[of][:, None] == of_traj))
            all_[to] += sums.sum(1)
            same[to] += (sums * (traj[to][:, None] == of_traj)).sum(1)

        if len(first) and len(second):
            for i, j, d in linear.fitted_rmsd_blocks(x[first], x[second]):
                one, other = first[i : i + d.shape[0]], second[j : j + d.shape[1]]
                add(d, one, other)
                if two and wanted[other[0]]:
                    add(d.T, other, one)
        t = t.append_column("s_all", pa.array(all_)).append_column("s_own", pa.array(same)).filter(pa.array(wanted))
        return t.select([group, "traj_id", "frame", "s_all", "s_own"])

    sums = _meetings(reps, group, tile, tiles, most).groupBy(group, "a", "b").applyInArrow(run, f"{group} {kind}, traj_id string, frame int, s_all double, s_own double")
    sums = sums.groupBy(group, "traj_id", "frame").agg(F.sum("s_all").alias("a"), F.sum("s_own").alias("o"))
    total = reps.groupBy(group).agg(F.sum("w").alias("total"))
    own_total = reps.groupBy(group, "traj_id").agg(F.sum("w").alias("own_total"))
    return sums.join(total, group).join(own_total, [group, "traj_id"]).select(group, "traj_id", "frame", (F.col("a") / F.col("total")).alias("mean_rmsd"), (F.col("o") / F.col("own_total")).alias("own_mean_rmsd"))


def medoids(frames: DataFrame, group: str, tile: int = 256, tiles: int = 16, most: int = 32768) -> DataFrame:
    """Mean RMSD of every frame to all frames of its group and of its own trajectory. Equal frames of a trajectory are fitted once and weighted. Frames are dealt into tiles; each unordered pair
    of tiles is a task's work, which sends two sums per frame, never the distances.

    frames: (group, traj_id, frame, xyz). Groups whose atom numbers differ keep their first trajectory only."""
    reps = _distinct(frames, group)
    means = _mean_rmsd(reps.withColumn("wanted", F.lit(True)), group, tile, tiles, most)
    return means.join(reps.select(group, "traj_id", "frame", "equal"), [group, "traj_id", "frame"]).select(group, "traj_id", F.explode("equal").alias("frame"), "mean_rmsd", "own_mean_rmsd")


def ensemble_medoids(frames: DataFrame, group: str, tile: int = 256, tiles: int = 16, most: int = 32768) -> DataFrame:
    """``pick_medoids`` of ``medoids``, whose exact means are made only for frames that can be the medoid: what each frame's mean is at least follows from bounds of all
    pairs, and none is the medoid whose least is above the exact mean of the frame with the lowest."""
    reps = _distinct(frames, group)
    kind = reps.schema[group].dataType.simpleString()

    def least(t: pa.Table) -> pa.Table:
        (x, first, second, two), w = _sides(t), t["w"].to_numpy().astype(float)
        low, weight = np.zeros(len(w)), w.astype(np.float32)
        if len(first) and len(second):
            for i, j, d in linear.least_rmsd_blocks(x[first], x[second]):
                r, c = first[i : i + d.shape[0]], second[j : j + d.shape[1]]
                low[r] += d @ weight[c]
                if two:
                    low[c] += weight[r] @ d
        return t.select([group, "traj_id", "frame"]).append_column("low", pa.array(low * (1 - 1e-4)))  # for the sums' single precision

    total = reps.groupBy(group).agg(F.sum("w").alias("total"))
    lows = _meetings(reps.withColumn("wanted", F.lit(True)), group, tile, tiles, most).groupBy(group, "a", "b").applyInArrow(least, f"{group} {kind}, traj_id string, frame int, low double")
    lows = lows.groupBy(group, "traj_id", "frame").agg(F.sum("low").alias("low")).join(total, group)
    lows = materialize(lows.select(group, "traj_id", "frame", (F.col("low") / F.col("total")).alias("low"), "total"), "bounds")
    lowest = lows.groupBy(group).agg(F.min(F.struct("low", "traj_id", "frame")).alias("m")).select(group, "m.traj_id", "m.frame")
    lowest = materialize(reps.join(lowest, [group, "traj_id", "frame"]).select(group, F.col("xyz").alias("ref")), "references")  # one a group

    def fit(batches):
        for b in batches:
            for n in np.unique(pc.list_value_length(b["xyz"]).to_numpy(zero_copy_only=False)):  # groups may differ in atoms
                part = b.filter(pc.equal(pc.list_value_length(b["xyz"]), int(n)))
                x, ref = stack(part["xyz"]), stack(part["ref"])
                d = np.sqrt(((linear.superpose_each(x, ref) - ref) ** 2).sum((1, 2)) / x.shape[1])
                yield pa.RecordBatch.from_arrays([part[group], part["w"], pa.array(d)], [group, "w", "d"])

    exact = reps.join(lowest, group).select(group, "w", "xyz", "ref").mapInArrow(fit, f"{group} {kind}, w long, d double")
    limit = exact.groupBy(group).agg((F.sum(F.col("d") * F.col("w")) / F.sum("w") * (1 + 1e-9)).alias("limit"))
    wanted = lows.join(limit, group).where(F.col("low") <= F.col("limit")).select(group, "traj_id", "frame", F.lit(True).alias("_can"))
    marked = materialize(reps.join(wanted, [group, "traj_id", "frame"], "left").withColumn("wanted", F.col("_can").isNotNull()).select(group, "traj_id", "frame", "xyz", "w", "wanted"), "candidates")
    means = _mean_rmsd(marked, group, tile, tiles, most)
    return pick_medoids(means, group).drop("n_frames").join(total, group).withColumnRenamed("total", "n_frames")


def pick_medoids(means: DataFrame, group: str) -> DataFrame:
    """The medoid of each group."""
    best = F.min(F.struct("mean_rmsd", "traj_id", "frame"))
    return means.groupBy(group).agg(best.alias("m"), F.count("*").alias("n_frames")).select(group, F.col("m.traj_id").alias("traj_id"), F.col("m.frame").alias("frame"), F.col("m.mean_rmsd").alias("mean_rmsd"), "n_frames")


def frame_clusters(features: DataFrame, weights: tuple[float, float, float] = (0.45, 0.25, 0.30), cutoff: float = 0.35, most: int = 6000) -> DataFrame:
    """Average-linkage clusters of a trajectory's sampled frames: three feature sets (geometry, side chains: Euclidean; interactions: Manhattan), each distance
    over its largest, blended.

    features: (traj_id, frame, geometry, sidechain, interaction), arrays. Up to ``most`` frames are linked in the trajectory's task, whose matrix takes 8 bytes a
    pair of frames and three times that at its peak; longer trajectories go through the rounds of ``linkage.linked_frames``, which keeps no distances, with the same clusters."""
    blend = dict(zip(("geometry", "sidechain", "interaction"), weights))

    def run(t: pa.Table) -> pa.Table:
        n = t.num_rows
        t = t.sort_by("frame")
        total = np.zeros((n, n))
        for name, weight in blend.items():
            x = np.array(t[name].to_pylist(), float).reshape(n, -1)
            d = linear.distances(x, manhattan=name == "interaction")
            peak = d.max(initial=0.0)
            total += weight * (d / peak if peak > 0 else d)
        labels = linear.average_linkage(total, cutoff) if n > 1 else np.zeros(n, int)
        return pa.table({"traj_id": t["traj_id"], "frame": t["frame"], "cluster": pa.array(labels, pa.int32())})

    long = features.groupBy("traj_id").count().where(F.col("count") > most).select("traj_id")
    linked = lambda f: f.groupBy("traj_id").applyInArrow(run, "traj_id string, frame int, cluster int")
    if long.isEmpty():
        return linked(features)
    rest = linkage.linked_frames(features.join(long, "traj_id", "left_semi"), blend, cutoff, ("interaction",))
    return linked(features.join(long, "traj_id", "left_anti")).unionByName(rest)
