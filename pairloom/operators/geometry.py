"""Geometry: extents, band alignment, transforms, warps by gather joins, shadow shifts, edge-connected nodata, nearest matches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.errors import CoregistrationError
from pairloom.operators.stencil import stencil
from pairloom.operators.tiles import with_halo

# --- catalog of pairs ---------------------------------------------------------------------------------------------


def common_bands(scenes: DataFrame, ref: str, mov: str) -> DataFrame:
    """ref_band, mov_band (from 1), name of bands that share a name, in the reference's order; by place if none does."""
    r = scenes.select(F.posexplode(ref).alias("i", "name"))
    m = scenes.select(F.posexplode(mov).alias("j", "other")).groupBy(F.lower("other").alias("_k")).agg(F.min("j").alias("j"))
    named = r.join(m, F.lower("name") == F.col("_k")).select((F.col("i") + 1).alias("ref_band"), (F.col("j") + 1).alias("mov_band"), "name")
    n = scenes.select(F.least(F.size(ref), F.size(mov)).alias("n"))
    placed = r.crossJoin(n).filter("i < n").select((F.col("i") + 1).alias("ref_band"), (F.col("i") + 1).alias("mov_band"), "name")  # one row on the right
    return named.unionByName(placed.join(named.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))


def pick_band(names: Sequence[str]) -> int:
    """1-based band that images are matched on: swir, else nir, else red, else the first."""
    for want in ("swir", "nir", "red"):
        for k, n in enumerate(names):
            if want in n.lower():
                return k + 1
    return 1


def overlap(dx: Column, dy: Column, ref: tuple[int, int], mov: tuple[int, int]) -> dict[str, Column]:
    """The rectangle, in reference pixels, that the moving image covers whose origin is at (dx, dy). Sizes: (height, width)."""
    zero = F.lit(0)
    c0, r0 = F.greatest(dx, zero), F.greatest(dy, zero)
    return {
        "col_off": c0, "row_off": r0,
        "width": F.greatest(F.least(F.lit(ref[1]), dx + mov[1]) - c0, zero), "height": F.greatest(F.least(F.lit(ref[0]), dy + mov[0]) - r0, zero),
    }


def coarse_alignment(pairs: DataFrame) -> DataFrame:
    """pairs (ref and mov: structs of crs and transform a..f) with offset_x, offset_y (the moving origin in reference pixels) and ratio."""
    r, m = F.col("ref.transform"), F.col("mov.transform")
    same = F.upper(F.trim("ref.crs")) == F.upper(F.trim("mov.crs"))
    sound = F.coalesce(same & r.isNotNull() & m.isNotNull(), F.lit(False))
    det = r["a"] * r["e"] - r["b"] * r["d"]
    x, y = m["c"] - r["c"], m["f"] - r["f"]

    def size(t: Column, p: str, q: str) -> Column:
        return F.abs(t[p]) + F.abs(t[q])

    ratio = (size(m, "a", "b") / size(r, "a", "b") + size(m, "d", "e") / size(r, "d", "e")) / 2
    guard = F.when(sound, det).otherwise(F.raise_error(F.lit("both images need the same CRS and a transform")).cast("double"))
    return pairs.withColumn("offset_x", (r["e"] * x - r["b"] * y) / guard).withColumn("offset_y", (r["a"] * y - r["d"] * x) / guard).withColumn("ratio", ratio)


# --- transforms: small models on the driver, columns or kernels on the executors ---------------------------------


def _checked(src: np.ndarray, dst: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    if src.shape != dst.shape or src.ndim != 2 or src.shape[1] != 2:
        raise CoregistrationError("points must be two (N, 2) arrays alike")
    if len(src) < least:
        raise CoregistrationError(f"{len(src)} points; {least} are needed")
    return src, dst


class Transform:
    """A map from moving to reference coordinates (x, y)."""

    name, least = "none", 0

    def apply(self, points: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def inverse_apply(self, points: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def residuals(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        return np.hypot(*(self.apply(src) - np.asarray(dst, float)).T)

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        raise NotImplementedError


class Affine(Transform):
    name, least = "affine", 3

    def __init__(self, matrix: Sequence[Sequence[float]]) -> None:
        self.m = np.asarray(matrix, float)[:2, :3]

    @classmethod
    def fit(cls, src: np.ndarray, dst: np.ndarray) -> Affine:
        src, dst = _checked(src, dst, cls.least)
        sol, _, rank, _ = np.linalg.lstsq(np.column_stack([src, np.ones(len(src))]), dst, rcond=None)
        if rank < 3:
            raise CoregistrationError("the points lie on a line")
        return cls(sol.T)

    @classmethod
    def fitted(cls, matches: DataFrame) -> Affine:
        """From a relation sx, sy, dx, dy of any size: the normal equations are one aggregation."""
        means = [F.avg(c).alias(k) for k, c in (("mx", "sx"), ("my", "sy"), ("mu", "dx"), ("mw", "dy"))]
        second = [F.var_pop("sx").alias("vxx"), F.var_pop("sy").alias("vyy"), F.covar_pop("sx", "sy").alias("vxy"), *[F.covar_pop(f"s{p}", f"d{q}").alias(f"c{p}{q}") for p in "xy" for q in "xy"]]
        row = matches.agg(F.count(F.lit(1)).alias("n"), *means, *second).first()
        if row["n"] < cls.least:
            raise CoregistrationError(f"{row['n']} points; {cls.least} are needed")
        var = np.array([[row["vxx"], row["vxy"]], [row["vxy"], row["vyy"]]])
        lin = np.linalg.solve(var, np.array([[row["cxx"], row["cxy"]], [row["cyx"], row["cyy"]]])).T
        shift = np.array([row["mu"], row["mw"]]) - lin @ np.array([row["mx"], row["my"]])
        return cls(np.column_stack([lin, shift]))

    def apply(self, points: np.ndarray) -> np.ndarray:
        return np.asarray(points, float) @ self.m[:, :2].T + self.m[:, 2]

    def inverse(self) -> Affine:
        lin = np.linalg.inv(self.m[:, :2])
        return Affine(np.column_stack([lin, -lin @ self.m[:, 2]]))

    def inverse_apply(self, points: np.ndarray) -> np.ndarray:
        return self.inverse().apply(points)

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        (a, b, c), (d, e, f) = self.m.tolist()
        return a * x + b * y + c, d * x + e * y + f

    def after(self, first: Affine) -> Affine:
        """This map after first."""
        full = [np.vstack([t.m, [0, 0, 1]]) for t in (self, first)]
        return Affine((full[0] @ full[1])[:2])


class Homography(Transform):
    name, least = "homography", 4

    def __init__(self, matrix: np.ndarray) -> None:
        self.m = np.asarray(matrix, float)

    @classmethod
    def fit(cls, src: np.ndarray, dst: np.ndarray) -> Homography:
        """Direct linear transform on normalised points."""
        src, dst = _checked(src, dst, cls.least)

        def norm(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mid = p.mean(axis=0)
            s = np.sqrt(2) / max(np.hypot(*(p - mid).T).mean(), 1e-12)
            t = np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1]])
            return (p - mid) * s, t

        (p, tp), (q, tq) = norm(src), norm(dst)
        z, one = np.zeros(len(p)), np.ones(len(p))
        rows = np.concatenate([np.column_stack([p, one, z, z, z, -q[:, :1] * p, -q[:, 0]]), np.column_stack([z, z, z, p, one, -q[:, 1:] * p, -q[:, 1]])])
        h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
        h = np.linalg.inv(tq) @ h @ tp
        if abs(h[2, 2]) < 1e-12:
            raise CoregistrationError("the points give no homography")
        return cls(h / h[2, 2])

    def _map(self, m: np.ndarray, points: np.ndarray) -> np.ndarray:
        v = np.column_stack([np.asarray(points, float), np.ones(len(points))]) @ m.T
        return v[:, :2] / v[:, 2:]

    def apply(self, points: np.ndarray) -> np.ndarray:
        return self._map(self.m, points)

    def inverse_apply(self, points: np.ndarray) -> np.ndarray:
        return self._map(np.linalg.inv(self.m), points)

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        (a, b, c), (d, e, f), (g, h, i) = self.m.tolist()
        w = g * x + h * y + i
        return F.try_divide(a * x + b * y + c, w), F.try_divide(d * x + e * y + f, w)


class ThinPlateSpline(Transform):
    name, least = "tps", 4

    def __init__(self, control: np.ndarray, weights: np.ndarray, back: ThinPlateSpline | None = None) -> None:
        self.control, self.weights, self.back = control, weights, back

    @staticmethod
    def _u(r2: np.ndarray) -> np.ndarray:
        return np.where(r2 > 0, r2 * np.log(np.maximum(r2, 1e-300)), 0.0)

    @classmethod
    def _solve(cls, src: np.ndarray, dst: np.ndarray, smooth: float) -> ThinPlateSpline:
        n = len(src)
        k = cls._u(((src[:, None] - src[None]) ** 2).sum(axis=2)) + smooth * np.eye(n)
        p = np.column_stack([np.ones(n), src])
        full = np.block([[k, p], [p.T, np.zeros((3, 3))]])
        try:
            return cls(src, np.linalg.solve(full, np.vstack([dst, np.zeros((3, 2))])))
        except np.linalg.LinAlgError as e:
            raise CoregistrationError("the spline's system is singular") from e

    @classmethod
    def fit(cls, src: np.ndarray, dst: np.ndarray, smooth: float = 1e-3) -> ThinPlateSpline:
        src, dst = _checked(src, dst, cls.least)
        out = cls._solve(src, dst, smooth)
        out.back = cls._solve(out.apply(src), src, smooth)
        return out

    def apply(self, points: np.ndarray) -> np.ndarray:
        points = np.asarray(points, float)
        u = self._u(((points[:, None] - self.control[None]) ** 2).sum(axis=2))
        return u @ self.weights[: len(self.control)] + np.column_stack([np.ones(len(points)), points]) @ self.weights[len(self.control) :]

    def inverse_apply(self, points: np.ndarray) -> np.ndarray:
        return self.back.apply(points)

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, out = len(self.control), []
        for d in (0, 1):
            w = self.weights[:, d].tolist()
            v = w[n] + w[n + 1] * x + w[n + 2] * y
            for (cx, cy), k in zip(self.control.tolist(), w):
                r2 = (x - cx) * (x - cx) + (y - cy) * (y - cy)
                v = v + k * F.when(r2 > 0, r2 * F.log(r2)).otherwise(0.0)
            out.append(v)
        return out[0], out[1]


def rmse(t: Transform, src: np.ndarray, dst: np.ndarray) -> float:
    return float(np.sqrt((t.residuals(src, dst) ** 2).mean()))


def select_transform(src: np.ndarray, dst: np.ndarray, affine_at: float = 0.75, homography_at: float = 0.75, tps_from: int = 30) -> tuple[Transform, float]:
    """The simplest model that fits: affine, else homography, else the best of all three."""
    affine = Affine.fit(src, dst)
    best, err = affine, rmse(affine, src, dst)
    n = len(src)
    if err <= affine_at or n < 4:
        return best, err
    try:
        h = Homography.fit(src, dst)
        e = rmse(h, src, dst)
        if e < err:
            best, err = h, e
            if e <= homography_at or n < tps_from:
                return best, err
    except (CoregistrationError, np.linalg.LinAlgError):
        pass
    if n < tps_from:
        return best, err
    spline = ThinPlateSpline.fit(src, dst)
    e = rmse(spline, src, dst)
    return (spline, e) if e < err else (best, err)


def split_matches(src: np.ndarray, dst: np.ndarray, share: float = 0.25, seed: int = 12345) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst to estimate from, src, dst to validate with) by a seeded permutation."""
    src, dst = _checked(src, dst, 8)
    order = np.random.default_rng(seed).permutation(len(src))
    held = max(2, int(round(share * len(src))))
    return src[order[held:]], dst[order[held:]], src[order[:held]], dst[order[:held]]


def evaluate(src: np.ndarray, dst: np.ndarray, target: float = 1.0) -> dict:
    """A model from three quarters of the matches, its error on the others."""
    es, ed, vs, vd = split_matches(src, dst)
    model, _ = select_transform(es, ed)
    r = model.residuals(vs, vd)
    out = {"model": model.name, "rmse_px": float(np.sqrt((r**2).mean())), "max_error_px": float(r.max()), "n_estimation": len(es), "n_validation": len(vs)}
    return out | {"target_met": out["rmse_px"] <= target, "transform": model}


def displacement_map(spark: SparkSession, t: Transform, height: int, width: int, step: int = 64) -> DataFrame:
    """row, col, displacement on a grid that starts at half a step."""
    rows = spark.range(step // 2, height, step).select(F.col("id").cast("int").alias("row"))
    cols = spark.range(step // 2, width, step).select(F.col("id").cast("int").alias("col"))
    x, y = t.columns(F.col("col").cast("double"), F.col("row").cast("double"))
    return rows.crossJoin(F.broadcast(cols)).select("row", "col", F.hypot(x - F.col("col"), y - F.col("row")).alias("displacement"))  # a scene's grid


# --- resampling ---------------------------------------------------------------------------------------------------


def gather(df: DataFrame, targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bilinear values of df (keys, row, col, v) at targets (row, col, sy, sx): four corners each, absent ones count as 0."""
    sy, sx = F.col("sy"), F.col("sx")
    y0, x0 = F.floor(sy), F.floor(sx)
    fy, fx = sy - y0, sx - x0
    corners = [F.struct((y0 + i).cast("int").alias("y"), (x0 + j).cast("int").alias("x"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)]
    need = targets.select("row", "col", F.explode(F.array(*corners)).alias("k")).select("row", "col", "k.*")
    src = df.select(F.col("row").alias("y"), F.col("col").alias("x"), "v")
    return need.join(src, ["y", "x"], "left").groupBy("row", "col").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def warp(df: DataFrame, t: Affine | Homography, height: int, width: int) -> DataFrame:
    """row, col, v of df (row, col, v) moved by t onto a raster of that size; from outside comes 0."""
    back = t.inverse() if isinstance(t, Affine) else Homography(np.linalg.inv(t.m))
    x, y = back.columns(F.col("col").cast("double"), F.col("row").cast("double"))
    return gather(df, grid(df.sparkSession, height, width).select("row", "col", y.alias("sy"), x.alias("sx")))


def warp_spline(df: DataFrame, t: ThinPlateSpline, height: int, width: int) -> DataFrame:
    """As warp; the inverse spline is evaluated for each pixel in Arrow batches."""

    def places(it):
        for pdf in it:
            p = t.inverse_apply(pdf[["col", "row"]].to_numpy(float))
            yield pdf.assign(sy=p[:, 1], sx=p[:, 0])

    return gather(df, grid(df.sparkSession, height, width).mapInPandas(places, "row int, col int, sy double, sx double"))


def resize(df: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Bilinear, pixel centres at halves, the border repeated. Sizes: (height, width)."""

    def place(k: Column, n_old: int, n_new: int) -> Column:
        at = (k + 0.5) * (n_old / n_new) - 0.5
        return F.least(F.greatest(at, F.lit(0.0)), F.lit(float(n_old - 1)))

    t = grid(df.sparkSession, *new).select("row", "col", place(F.col("row"), old[0], new[0]).alias("sy"), place(F.col("col"), old[1], new[1]).alias("sx"))
    return gather(df, t)


_TAPS = np.array([1, 4, 6, 4, 1]) / 16


def pyramid_down(df: DataFrame, height: int, width: int) -> DataFrame:
    """row, col, v at half size: five taps along either axis, reflected at the border, every other row and column."""

    def kernel(padded: np.ndarray, block: np.ndarray, core: tuple[slice, slice]) -> dict[str, np.ndarray]:
        rows = sum(t * padded[k : padded.shape[0] - 4 + k] for k, t in enumerate(_TAPS))
        return {"v": sum(t * rows[:, k : rows.shape[1] - 4 + k] for k, t in enumerate(_TAPS))}

    return stencil(df, height, width, 2, kernel, {"v": "double"}, keep=(2, 2))


# --- masks that need geometry -------------------------------------------------------------------------------------


def shadow_shifts(elevation: float, azimuth: float, pixel_m: float, heights: Sequence[float]) -> list[tuple[int, int]]:
    """(dx, dy) in pixels for each cloud height; halves go to the even number."""
    e, a = np.radians(elevation), np.radians(azimuth)
    d = np.asarray(heights, float) / np.tan(e) / pixel_m
    return [(int(x), int(y)) for x, y in zip(np.rint(-d * np.sin(a)), np.rint(d * np.cos(a)))]


#: Metres, in even steps.
HEIGHTS = tuple(np.linspace(300.0, 3000.0, 6).tolist())


def project_shadow(clouds: DataFrame, elevation: float, azimuth: float, pixel_m: float, heights: Sequence[float], height: int, width: int) -> DataFrame:
    """row, col of where clouds (row, col) cast shadows for any of the heights, within the raster."""
    shifts = sorted(set(shadow_shifts(elevation, azimuth, pixel_m, heights)))
    moved = F.explode(F.array(*[F.struct((F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col")) for dx, dy in shifts]))
    return clouds.select(moved.alias("p")).select(F.col("p.row").cast("int").alias("row"), F.col("p.col").cast("int").alias("col")).filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def confirm_shadows(pixels: DataFrame, clouds: DataFrame, elevation: float, azimuth: float, pixel_m: float, heights: Sequence[float], height: int, width: int, dark_at: float = 25) -> DataFrame:
    """row, col of projected shadows outside clouds whose nir is among the darkest dark_at percent of cloudless pixels (row, col, nir); without any such pixel, all of them unconfirmed."""
    clear = pixels.filter("nir is not null and not isnan(nir)").join(clouds.select("row", "col"), ["row", "col"], "left_anti")
    mark = clear.agg(F.percentile("nir", F.lit(dark_at / 100)).alias("_p"))
    shadow = project_shadow(clouds, elevation, azimuth, pixel_m, heights, height, width)
    found = shadow.join(clouds.select("row", "col"), ["row", "col"], "left_anti").join(clear.select("row", "col", "nir"), ["row", "col"], "left")
    return found.crossJoin(F.broadcast(mark)).filter("_p is null or nir <= _p").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))  # one row on the right


def _labels(mask: np.ndarray) -> np.ndarray:
    """4-connected components of mask, from 1; 0 outside. Two passes with union-find over runs."""
    h, w = mask.shape
    lab, up = np.zeros((h, w), np.int64), [0]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for r in range(h):
        edge = np.diff(np.concatenate([[0], mask[r].astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            above = np.unique(lab[r - 1, a:b]) if r else np.zeros(0, np.int64)
            roots = sorted({root(int(x)) for x in above if x})
            if not roots:
                up.append(len(up))
                roots = [len(up) - 1]
            for x in roots[1:]:
                up[x] = roots[0]
            lab[r, a:b] = roots[0]
    return np.array([root(i) for i in range(len(up))])[lab]


def edge_connected(bad: DataFrame, height: int, width: int, size: int = 512) -> DataFrame:
    """row, col of pixels of bad (row, col) that are 4-connected to the raster's border.

    Components are labelled within tiles; tiles then join over their common edges, and what touches the border spreads over
    that small graph, a join a round, until nothing is added.
    """
    across = -(-width // size)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = int(pdf["tile_index"].iloc[0])
        i, j = divmod(tile, across)
        m = np.zeros((min(size, height - i * size), min(size, width - j * size)), bool)
        r, c = pdf["row"].to_numpy() - i * size, pdf["col"].to_numpy() - j * size
        m[r, c] = True
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "comp": (tile << 32) + _labels(m)[r, c]})

    spark = bad.sparkSession
    tiled = with_halo(bad.select("row", "col"), height, width, size, 0).filter("core")
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pairloom-"))
    lab = tiled.groupBy("tile_index").applyInPandas(label, "row int, col int, comp long").checkpoint()
    far = lab.filter(((F.col("row") % size == size - 1) | (F.col("col") % size == size - 1)))
    step = F.explode(F.array(F.struct((F.col("row") + 1).alias("row"), F.col("col").alias("col")), F.struct(F.col("row").alias("row"), (F.col("col") + 1).alias("col"))))
    touching = far.select("comp", step.alias("p")).select(F.col("comp").alias("a"), "p.row", "p.col").join(lab.select("row", "col", F.col("comp").alias("b")), ["row", "col"]).filter("a <> b").select("a", "b").distinct()
    edges = touching.unionByName(touching.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    border = (F.col("row") == 0) | (F.col("row") == height - 1) | (F.col("col") == 0) | (F.col("col") == width - 1)
    found = lab.filter(border).select(F.col("comp").alias("a")).distinct().checkpoint()
    new = found
    while new.head(1):
        new = new.join(edges, "a").select(F.col("b").alias("a")).distinct().join(found, "a", "left_anti").checkpoint()
        found = found.unionByName(new)
    return lab.join(found.select(F.col("a").alias("comp")), "comp", "left_semi").select("row", "col")


# --- matches ------------------------------------------------------------------------------------------------------


def ratio_matches(queries: DataFrame, items: DataFrame, key: str, vector: str, ratio: float = 0.75, block: int = 512) -> DataFrame:
    """query_id, near_id, distance, kept: each query's nearest other item, kept if it is nearer than ratio times the second.

    Both sides are packed into blocks; a task holds one block of either and keeps two candidates a query.
    """

    def blocks(df: DataFrame, salt: int) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("x")).groupBy(F.floor(F.col("id") / (block * salt)).alias("b")).agg(F.collect_list(F.struct("id", "x")).alias("rows"))

    def best(it):
        for pdf in it:
            for q, e in zip(pdf["q"], pdf["e"]):
                qi, ei = np.array([r["id"] for r in q]), np.array([r["id"] for r in e])
                qx, ex = np.array([list(r["x"]) for r in q]), np.array([list(r["x"]) for r in e])
                d = ((qx[:, None, :] - ex[None]) ** 2).sum(axis=2)
                d[qi[:, None] == ei[None]] = np.inf
                order = np.lexsort((np.broadcast_to(ei, d.shape), d))[:, :2]
                for k in range(order.shape[1]):
                    at = order[:, k]
                    dist = d[np.arange(len(qi)), at]
                    ok = np.isfinite(dist)
                    yield pd.DataFrame({"query_id": qi[ok], "near_id": ei[at][ok], "d2": dist[ok]})

    pairs = blocks(queries, 20).select(F.col("rows").alias("q")).crossJoin(blocks(items, 1).select(F.col("rows").alias("e")))  # blocks of the query set against blocks of all rows
    near = pairs.mapInPandas(best, "query_id long, near_id long, d2 double")
    w = Window.partitionBy("query_id").orderBy("d2", "near_id")
    two = near.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("query_id").agg(F.min_by("near_id", "k").alias("near_id"), F.min("d2").alias("a"), F.max("d2").alias("b"), F.count(F.lit(1)).alias("n"))
    return two.filter("n = 2").select("query_id", "near_id", F.sqrt("a").alias("distance"), (F.sqrt("a") < ratio * F.sqrt("b")).alias("kept"))
