"""Tiles, colours, frames and quality figures. Pixels stay in arrays; per-image work is narrow (no shuffle).

Give `psnr` and `block_means` finished columns, not nested expressions: an array expression inside a lambda
would be evaluated again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import ordered
from ..functions.columns import ext_of, js_round

PAD = 16
GRAPHIC_COLORS = 32_768
CHUNK_BYTES = 160_000_000


def tile_grid(images: DataFrame, w: str, h: str, tile: str) -> DataFrame:
    """Core tiles of an image with their padded boxes clamped to it."""
    W, H, t = F.col(w), F.col(h), F.col(tile)
    rows, cols = F.sequence(F.lit(0), F.ceil(H / t).cast("int") - 1), F.sequence(F.lit(0), F.ceil(W / t).cast("int") - 1)
    g = images.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
    x, y = F.col("col") * t, F.col("row") * t
    g = g.withColumn("x", x).withColumn("y", y).withColumn("cw", F.least(t, W - x)).withColumn("ch", F.least(t, H - y))
    g = g.withColumn("px0", F.greatest(F.lit(0), F.col("x") - PAD)).withColumn("py0", F.greatest(F.lit(0), F.col("y") - PAD))
    return (g.withColumn("pw", F.least(W, F.col("x") + F.col("cw") + PAD) - F.col("px0"))
            .withColumn("ph", F.least(H, F.col("y") + F.col("ch") + PAD) - F.col("py0")))


def stitch_tiles(tiles: DataFrame, w: str, h: str, out_w: str, out_h: str) -> DataFrame:
    """Scaled core rectangles; both edges are rounded so that neighbours meet."""
    kx, ky = F.col(out_w) / F.col(w), F.col(out_h) / F.col(h)
    dx, dy = js_round(F.col("x") * kx), js_round(F.col("y") * ky)
    return (tiles.withColumn("dx", dx).withColumn("dy", dy)
            .withColumn("dw", js_round((F.col("x") + F.col("cw")) * kx) - F.col("dx"))
            .withColumn("dh", js_round((F.col("y") + F.col("ch")) * ky) - F.col("dy")))


def color_count(px: Column, channels: int) -> Column:
    """Distinct RGB colours over every pixel."""
    n = F.floor(F.size(px) / channels).cast("int")

    def rgb(i):
        return sum(F.get(px, i * channels + k) * (1 << (16 - 8 * k)) for k in range(3))
    return F.when(n > 0, F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), rgb)))).otherwise(0)


def few_colors(px: Column, channels: int, limit: int = GRAPHIC_COLORS) -> Column:
    return color_count(px, channels) <= limit


def has_alpha(px: Column, channels: int = 4) -> Column:
    return F.size(F.filter(px, lambda v, i: (i % channels == channels - 1) & (v < 255))) > 0


def shrink_format(name: Column, alpha: Column, few: Column) -> Column:
    ext = ext_of(name)
    graphic = alpha | (ext.isin("png", "bmp", "tif", "tiff") & few)
    return F.when(graphic, "png").when(ext == "webp", "webp").otherwise("jpg")


def frames_equal(a: Column, b: Column, tolerance: int = 2) -> Column:
    close = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda v: v)
    return F.coalesce((F.size(a) == F.size(b)) & close, F.lit(False))


def same_frame(frames: DataFrame, stream: str = "stream", order: str = "frame_no", width: float = 4096) -> DataFrame:
    """Flag frames equal to their predecessor. A long stream is compared in stretches of its frame numbers."""
    prev = ordered.neighbour(frames, [stream], order, "_prev", F.col("px"), width=width)
    return prev.withColumn("same", F.when(F.col("_prev").isNull(), F.lit(False)).otherwise(frames_equal(F.col("px"), F.col("_prev")))).drop("_prev")


def reuse_results(flagged: DataFrame, stream: str = "stream", order: str = "frame_no", width: float = 4096) -> DataFrame:
    """Number of the frame whose computed result each frame shows, and frames skipped so far."""
    light = ordered.cut(flagged.drop("px"))
    return ordered.running(light, [stream], order, {
        "result_of": ("max", F.when(~F.col("same"), F.col(order))),
        "skipped": ("sum", F.col("same").cast("long"))}, width=width)


def frame_chunk_size(w: Column, h: Column, out_w: Column, out_h: Column, has_encoder: Column) -> Column:
    each = w * h * 3 + F.when(has_encoder, F.lit(0)).otherwise(out_w * out_h * 4)
    return F.greatest(F.lit(4), F.least(F.lit(240), F.floor(F.lit(CHUNK_BYTES) / each)))


def frame_chunks(frames: DataFrame, chunk: Column, fps: Column, stream: str = "stream", order: str = "frame_no") -> DataFrame:
    """Chunks of a stream: number, start second, frame count. `order` counts frames from 0."""
    c = frames.withColumn("chunk_no", F.floor(F.col(order) / chunk)).withColumn("_start", F.floor(F.col(order) / chunk) * chunk / fps)
    return c.groupBy(stream, "chunk_no").agg(F.min("_start").alias("start_sec"), F.count("*").alias("n_frames"))


def luma(px: Column, channels: int) -> Column:
    """Luma plane of 0-255 pixels (grey when there is one channel)."""
    if channels == 1:
        return F.transform(px, lambda v: F.lit(16.0) + (65.481 + 128.553 + 24.966) * v / 255.0)
    n = F.floor(F.size(px) / channels).cast("int")

    def y(i):
        r, g, b = (F.get(px, i * channels + k) / 255.0 for k in range(3))
        return F.lit(16.0) + 65.481 * r + 128.553 * g + 24.966 * b
    return F.transform(F.sequence(F.lit(0), n - 1), y)


def psnr(a: Column, b: Column, width: Column, height: Column, border: int) -> Column:
    """Peak signal-to-noise ratio of two luma planes without their border; infinite for equal ones."""
    def inner(i):
        x, y = i % width, F.floor(i / width)
        return (x >= border) & (x < width - border) & (y >= border) & (y < height - border)
    sq = F.filter(F.transform(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), lambda v, i: F.when(inner(i), v)), lambda v: v.isNotNull())
    mse = F.aggregate(sq, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(sq), F.lit(0))
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / mse))


def structural_similarity(pairs: DataFrame, a: str, b: str, width: int, height: int, border: int = 0, window: int = 7, peak: float = 255.0,
                          out: str = "ssim") -> DataFrame:
    """`pairs` with the mean structural similarity of the planes `a` and `b` (arrays of width * height values, row by row):
    luminance, contrast and structure in every window of window x window pixels inside the border, all pixels of a window
    alike, sample variances. Null for a missing plane, one of another size, or one with no room for a window.

    The window sums come from running sums over rows and columns, so the work is linear in the pixels whatever the window.
    """
    schema = StructType([*pairs.schema.fields, StructField(out, DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            planes = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b)]
            made = [_similarity(x, y, width, height, border, window, peak) for x, y in zip(*planes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], [*batch.schema.names, out])

    return pairs.mapInArrow(run, schema)


def _similarity(x, y, width: int, height: int, border: int, window: int, peak: float) -> float | None:
    import numpy as np

    if x is None or y is None or len(x) != width * height or len(y) != width * height or min(width, height) - 2 * border < window:
        return None
    p, q = (np.array(v, float).reshape(height, width)[border:height - border, border:width - border] for v in (x, y))
    n = window * window

    def mean(m):
        total = np.zeros((m.shape[0] + 1, m.shape[1] + 1))
        total[1:, 1:] = m.cumsum(0).cumsum(1)
        return (total[window:, window:] - total[:-window, window:] - total[window:, :-window] + total[:-window, :-window]) / n

    up, uq = mean(p), mean(q)
    vp, vq, both = (n / (n - 1) * (mean(m) - u) for m, u in ((p * p, up * up), (q * q, uq * uq), (p * q, up * uq)))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return float(((2 * up * uq + c1) * (2 * both + c2) / ((up * up + uq * uq + c1) * (vp + vq + c2))).mean())


def block_means(plane: Column, width: int, height: int, factor: int) -> Column:
    """Plane reduced by averaging factor x factor blocks (stands in for an antialiased reduction)."""
    w, h = width // factor, height // factor

    def block(i):
        x0, y0 = (i % w) * factor, F.floor(i / w).cast("int") * factor
        cells = [F.get(plane, (y0 + dy) * width + x0 + dx) for dy in range(factor) for dx in range(factor)]
        return sum(cells[1:], cells[0]) / float(factor * factor)
    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), block)


def quality_summary(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def residual_shrink(residual: Column, core: Column) -> Column:
    return F.transform(residual, lambda r: F.signum(r) * F.greatest(F.abs(r) - core, F.lit(0.0)))


def eta_seconds(elapsed_ms: Column, done: Column, total: Column) -> Column:
    return F.when(done >= 1, elapsed_ms / done * (total - done) / 1000)


def eta_label(sec: Column) -> Column:
    short = F.concat(F.lit(" · 약 "), F.greatest(F.lit(1), js_round(sec)).cast("string"), F.lit("초 남음"))
    mid = F.concat(F.lit(" · 약 "), js_round(sec / 60).cast("string"), F.lit("분 남음"))
    long = F.concat(F.lit(" · 약 "), F.regexp_replace(F.format_number(sec / 3600, 1), ",", ""), F.lit("시간 남음"))
    return F.when(sec.isNull(), F.lit("")).when(sec < 60, short).when(sec < 3600, mid).otherwise(long)
