"""G: tiles, colours, frames, quality."""

from pyspark.sql import functions as F

from ..operators import frames as G
from ..sources import views as V
from ..sources.tables import table
from ..streaming import live
from ..streaming.replay import replay
from .registry import query

_TILES = {"f_img": "SELECT p_partkey AS id, p_size * 20 AS w, floor(p_retailprice / 3)::INT AS h, CASE WHEN p_partkey % 2 = 0 THEN 128 ELSE 192 END AS t FROM part",
          "f_tiles": """SELECT *, r * t AS y, c * t AS x, least(t, w - c * t) AS cw, least(t, h - r * t) AS ch FROM (SELECT *, unnest(range((w + t - 1) // t)) AS c FROM (SELECT *, unnest(range((h + t - 1) // t)) AS r FROM f_img))"""}


def _tiles(spark, d):
    img = table(spark, d, "part").selectExpr("p_partkey as id", "p_size * 20 as w", "cast(floor(p_retailprice / 3) as int) as h", "if(p_partkey % 2 = 0, 128, 192) as t")
    return G.tile_grid(img, "w", "h", "t")


@query("tile_grid", """SELECT id, x, y, cw, ch, greatest(0, x - 16) AS px0, greatest(0, y - 16) AS py0, least(w, x + cw + 16) - greatest(0, x - 16) AS pw, least(h, y + ch + 16) - greatest(0, y - 16) AS ph FROM f_tiles""", _TILES)
def _(spark, d):
    return _tiles(spark, d).select("id", "x", "y", "cw", "ch", "px0", "py0", "pw", "ph")


@query("stitch_tiles", """SELECT id, x, y, floor(x * kx + 0.5)::BIGINT AS dx, floor(y * ky + 0.5)::BIGINT AS dy, (floor((x + cw) * kx + 0.5) - floor(x * kx + 0.5))::BIGINT AS dw, (floor((y + ch) * ky + 0.5) - floor(y * ky + 0.5))::BIGINT AS dh
FROM (SELECT *, (w * 7 // 3)::DOUBLE / w AS kx, (h * 9 // 4)::DOUBLE / h AS ky FROM f_tiles)""", _TILES)
def _(spark, d):
    t = _tiles(spark, d).withColumn("ow", F.expr("w * 7 div 3")).withColumn("oh", F.expr("h * 9 div 4"))
    return G.stitch_tiles(t, "w", "h", "ow", "oh").select("id", "x", "y", "dx", "dy", "dw", "dh")


_COARSE = "list_transform(px, lambda v: v // 32 * 32)"


@query("few_colors", f"""SELECT vec_id, count(DISTINCT rgb) AS n_colors, count(DISTINCT rgb) <= 12 AS few FROM (SELECT vec_id, c[i * 3 + 1] * 65536 + c[i * 3 + 2] * 256 + c[i * 3 + 3] AS rgb FROM (
  SELECT vec_id, {_COARSE} AS c, unnest(range(22)) AS i FROM f_pixels)) GROUP BY vec_id""")
def _(spark, d):
    p = V.pixels(spark, d).select("vec_id", F.transform("px", lambda v: F.floor(v / 32).cast("int") * 32).alias("px"))
    return p.select("vec_id", G.color_count(F.col("px"), 3).alias("n_colors"), G.few_colors(F.col("px"), 3, 12).alias("few"))


@query("has_alpha", "SELECT vec_id, vec_id % 3 = 0 AS transparent FROM f_pixels")
def _(spark, d):
    p = V.bytes_of(spark, d).select("vec_id", F.expr("transform(px, (v, i) -> if(i % 4 = 3 and vec_id % 3 <> 0, 255, v))").alias("px"))
    return p.select("vec_id", G.has_alpha(F.col("px")).alias("transparent"))


_SHRINK = {"f_few": f"""SELECT vec_id, count(DISTINCT c[i * 3 + 1] * 65536 + c[i * 3 + 2] * 256 + c[i * 3 + 3]) <= 12 AS few FROM (SELECT vec_id, {_COARSE} AS c, unnest(range(22)) AS i FROM f_pixels) GROUP BY vec_id"""}


@query("shrink_format", """SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR (ext IN ('png', 'bmp', 'tif', 'tiff') AND few) THEN 'png' WHEN ext = 'webp' THEN 'webp' ELSE 'jpg' END AS out_ext FROM f_ext JOIN f_few ON doc_id = vec_id""", _SHRINK)
def _(spark, d):
    p = V.pixels(spark, d).select(F.col("vec_id").alias("doc_id"), F.transform("px", lambda v: F.floor(v / 32).cast("int") * 32).alias("px"))
    j = V.files(spark, d).join(p, "doc_id")
    return j.select("doc_id", G.shrink_format(F.col("name"), F.expr("doc_id % 11 = 0"), G.few_colors(F.col("px"), 3, 12)).alias("out_ext"))


_SAME = {"f_same": """SELECT stream, frame_no, prev IS NOT NULL AND len(list_filter(list_zip(px, prev), lambda z: abs(z[1] - z[2]) > 2)) = 0 AS same FROM (
   SELECT *, lag(px) OVER (PARTITION BY stream ORDER BY frame_no) AS prev FROM (SELECT stream, frame_no, list_transform(px, lambda v: v * 2) AS px FROM f_frames))"""}


def frames(spark, d):
    return V.frames(spark, d).select("stream", "frame_no", F.transform("px", lambda v: v * 2).alias("px"))


@query("same_frame", "SELECT stream, frame_no, same FROM f_same", _SAME)
def _(spark, d):
    return G.same_frame(frames(spark, d)).select("stream", "frame_no", "same")


@query("reuse_results", """SELECT stream, frame_no, max(CASE WHEN NOT same THEN frame_no END) OVER w AS result_of, (sum(same::INT) OVER w)::BIGINT AS skipped FROM f_same
WINDOW w AS (PARTITION BY stream ORDER BY frame_no)""", _SAME)
def reuse_results(spark, d):
    return G.reuse_results(G.same_frame(frames(spark, d))).select("stream", "frame_no", "result_of", "skipped")


@query("stream_frame_dedupe", """SELECT stream, frame_no, same, max(CASE WHEN NOT same THEN frame_no END) OVER w AS result_of, (sum(same::INT) OVER w)::BIGINT AS skipped FROM f_same
WINDOW w AS (PARTITION BY stream ORDER BY frame_no)""", _SAME)
def stream_frame_dedupe(spark, d):
    """The live form over all frames of 25 a second, fed as they would arrive."""
    f = frames(spark, d).select(F.col("stream").cast("long").alias("stream"), "frame_no", F.col("frame_no").cast("long").alias("seq"),
                                F.timestamp_millis(F.col("frame_no") * 40).alias("ts"), "px")
    return replay(f, lambda s, late, quiet: live.stream_frame_dedupe(s, f"{late} milliseconds", quiet_ms=quiet))


@query("frame_chunks", """SELECT stream, (frame_no - 1) // c AS chunk_no, min((frame_no - 1) // c * c / 30.0::DOUBLE) AS start_sec, count(*) AS n_frames FROM (SELECT stream, frame_no,
  greatest(4, least(240, 160000000 // (w * h * 3 + CASE WHEN stream % 2 = 0 THEN 0 ELSE w * h * 16 END))) AS c FROM (SELECT *, 200 + 300 * stream AS w, 150 + 200 * stream AS h FROM f_frames)) GROUP BY stream, chunk_no""")
def _(spark, d):
    f = V.frames(spark, d).withColumn("w", F.expr("200 + 300 * stream")).withColumn("h", F.expr("150 + 200 * stream")).withColumn("n", F.col("frame_no") - 1)
    chunk = G.frame_chunk_size(F.col("w").cast("long"), F.col("h").cast("long"), F.col("w").cast("long") * 2, F.col("h").cast("long") * 2, F.expr("stream % 2 = 0"))
    return G.frame_chunks(f, chunk, F.lit(30.0), order="n")


_PSNR = {"f_luma": """SELECT vec_id, label, list_transform(range(22), lambda i: 16 + 65.481::DOUBLE * (px[i * 3 + 1] / 255.0::DOUBLE) + 128.553::DOUBLE * (px[i * 3 + 2] / 255.0::DOUBLE) + 24.966::DOUBLE * (px[i * 3 + 3] / 255.0::DOUBLE)) AS y FROM f_pixels""",
         "f_mse": """SELECT a.vec_id, a.label, avg((a.y[i] - b.y[i]) ** 2) AS mse FROM f_luma a JOIN f_luma b ON b.vec_id = a.vec_id + 1, (SELECT unnest(range(1, 23)) AS i) GROUP BY a.vec_id, a.label"""}


def _pairs(spark, d):
    p = V.pixels(spark, d).select("vec_id", "label", "px")
    return p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("px2")), "vec_id")


@query("psnr", "SELECT vec_id, round(10 * log10(65025.0::DOUBLE / mse), 6) AS psnr FROM f_mse", _PSNR)
def _(spark, d):
    j = _pairs(spark, d).select("vec_id", G.luma(F.col("px"), 3).alias("y"), G.luma(F.col("px2"), 3).alias("y2"))
    return j.select("vec_id", F.round(G.psnr(F.col("y"), F.col("y2"), F.lit(11), F.lit(2), 0), 6).alias("psnr"))


_QUAL = _PSNR | {"f_gray": "SELECT vec_id, list_transform(embedding, lambda v: 16 + (65.481::DOUBLE + 128.553::DOUBLE + 24.966::DOUBLE) * floor(128 + 127 * v::DOUBLE)::INT / 255.0::DOUBLE) AS y FROM embeddings",
                 "f_down": """SELECT vec_id, list_transform(range(16), lambda i: (y[i // 4 * 16 + i % 4 * 2 + 1] + y[i // 4 * 16 + i % 4 * 2 + 2] + y[i // 4 * 16 + i % 4 * 2 + 9] + y[i // 4 * 16 + i % 4 * 2 + 10]) / 4) AS y FROM f_gray""",
                 "f_cons": "SELECT a.vec_id, avg((a.y[i] - b.y[i]) ** 2) AS mse FROM f_down a JOIN f_down b ON b.vec_id = a.vec_id + 1, (SELECT unnest([6, 7, 10, 11]) AS i) GROUP BY a.vec_id"}


@query("quality_summary", """SELECT vec_id % 3 AS condition, label AS method, count(*) AS n, round(avg(10 * log10(65025.0::DOUBLE / m.mse)), 6) AS psnr, round(avg(10 * log10(65025.0::DOUBLE / c.mse)), 6) AS consistency
FROM f_mse m JOIN f_cons c USING (vec_id) GROUP BY vec_id % 3, label""", _QUAL)
def _(spark, d):
    g = V.bytes_of(spark, d).withColumnRenamed("px", "g")
    j = _pairs(spark, d).join(g, "vec_id").join(g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("g2")), "vec_id")
    j = j.select("vec_id", "label", G.luma(F.col("px"), 3).alias("y"), G.luma(F.col("px2"), 3).alias("y2"), G.luma(F.col("g"), 1).alias("l"), G.luma(F.col("g2"), 1).alias("l2"))
    j = j.select("vec_id", "label", "y", "y2", G.block_means(F.col("l"), 8, 8, 2).alias("m"), G.block_means(F.col("l2"), 8, 8, 2).alias("m2"))
    s = j.select(F.expr("vec_id % 3").alias("condition"), F.col("label").alias("method"), G.psnr(F.col("y"), F.col("y2"), F.lit(11), F.lit(2), 0).alias("psnr"),
                 G.psnr(F.col("m"), F.col("m2"), F.lit(4), F.lit(4), 1).alias("consistency"))
    q = G.quality_summary(s, ["condition", "method"], ["psnr", "consistency"])
    return q.select("condition", "method", "n", F.round("psnr", 6).alias("psnr"), F.round("consistency", 6).alias("consistency"))


_SSIM = _QUAL | {"f_win": """SELECT vec_id, oy, ox, avg(p) AS up, avg(q) AS uq, avg(p * p) AS pp, avg(q * q) AS qq, avg(p * q) AS pq
   FROM (SELECT a.vec_id, oy, ox, a.y[(oy + i // 7) * 8 + ox + i % 7 + 1] AS p, b.y[(oy + i // 7) * 8 + ox + i % 7 + 1] AS q FROM f_gray a JOIN f_gray b ON b.vec_id = a.vec_id + 1,
     (SELECT unnest(range(49)) AS i), (SELECT unnest([0, 1]) AS oy), (SELECT unnest([0, 1]) AS ox)) GROUP BY vec_id, oy, ox"""}


@query("structural_similarity", """SELECT vec_id, round(avg((2 * up * uq + 6.5025::DOUBLE) * (2 * 49 / 48.0::DOUBLE * (pq - up * uq) + 58.5225::DOUBLE)
  / ((up * up + uq * uq + 6.5025::DOUBLE) * (49 / 48.0::DOUBLE * (pp - up * up) + 49 / 48.0::DOUBLE * (qq - uq * uq) + 58.5225::DOUBLE))), 6) AS ssim FROM f_win GROUP BY vec_id""", _SSIM)
def _(spark, d):
    g = V.bytes_of(spark, d).select("vec_id", G.luma(F.col("px"), 1).alias("a"))
    pairs = g.join(g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return G.structural_similarity(pairs, "a", "b", 8, 8).select("vec_id", F.round("ssim", 6).alias("ssim"))


@query("residual_shrink", """SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CAST(floor(sign(v::DOUBLE) * greatest(abs(v::DOUBLE) - 0.015::DOUBLE, 0) * 1000000)::BIGINT AS VARCHAR)), ',') AS residual FROM embeddings""")
def _(spark, d):
    r = G.residual_shrink(F.transform("embedding", lambda v: v.cast("double")), F.lit(0.015))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(r, lambda v: F.floor(v * 1000000).cast("string")), ",").alias("residual"))


@query("eta", """SELECT seq, round(sec, 6) AS sec, CASE WHEN sec IS NULL THEN '' WHEN sec < 60 THEN ' · 약 ' || greatest(1, floor(sec + 0.5))::BIGINT || '초 남음' WHEN sec < 3600 THEN ' · 약 ' || floor(sec / 60 + 0.5)::BIGINT || '분 남음'
  ELSE ' · 약 ' || format('{:.1f}', sec / 3600) || '시간 남음' END AS label FROM (SELECT seq, CASE WHEN done >= 1 THEN (seq * 3701 % 9000000)::DOUBLE / done * (10 - done) / 1000 END AS sec
  FROM (SELECT seq, seq % 10 AS done FROM f_logs))""")
def _(spark, d):
    s = V.logs(spark, d).selectExpr("seq", "cast(seq * 3701 % 9000000 as double) as ms", "seq % 10 as done").select("seq", G.eta_seconds(F.col("ms"), F.col("done"), F.lit(10)).alias("sec"))
    return s.select("seq", F.round("sec", 6).alias("sec"), G.eta_label(F.col("sec")).alias("label"))
