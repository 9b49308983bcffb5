"""File corpus: names, categories, targets, signatures, plans and reports.

Rule tables are at most a few dozen entries and travel as literal maps inside the expressions, so
routing a file needs no join. Batches are never gathered: per-batch results come from partially
aggregated groups or from the two-level ordered helpers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.columns import (ext_of, first_rule, js_round, list_map, lookup, stem_of, str_array, str_map)
from ..rules import formats as R

_CAT_OF_EXT: dict[str, str] = {}
for _cat, (_engine, _exts, _targets) in R.CATEGORIES.items():
    for _e in _exts:
        _CAT_OF_EXT.setdefault(_e, _cat)


def dedupe_files(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the earliest row of equal keys. A partial aggregate, so a key with many copies stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return kept.select(*keys, "_r.*").select(*df.columns)


def file_ext_stem(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("ext", ext_of(name)).withColumn("stem", stem_of(name))


def category(ext: Column) -> Column:
    return lookup(str_map(_CAT_OF_EXT), ext)


def engine(cat: Column) -> Column:
    return lookup(str_map({c: v[0] for c, v in R.CATEGORIES.items()}), cat)


def targets(ext: Column) -> Column:
    """Ordered targets of a file by extension; empty for an unsupported one."""
    cat_targets = lookup(list_map({c: v[2] for c, v in R.CATEGORIES.items()}), category(ext))
    extra = F.coalesce(lookup(list_map(R.EXTRA_FOR), ext), str_array([]))
    own = F.coalesce(lookup(str_map(R.SAME), ext), ext)
    banned = F.coalesce(lookup(list_map(R.NOT_FOR), ext), str_array([]))
    listed = F.filter(F.concat(cat_targets, extra), lambda t: (t != own) & ~F.array_contains(banned, t))
    return F.coalesce(listed, str_array([]))


def file_category(df: DataFrame, name: str = "name") -> DataFrame:
    cat = category(ext_of(name))
    return df.withColumn("category", cat).withColumn("engine", engine(cat))


def file_targets(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("targets", targets(ext_of(name)))


def usable_files(df: DataFrame, name: str = "name") -> DataFrame:
    return df.filter(category(ext_of(name)).isNotNull()).filter(F.size(targets(ext_of(name))) > 0)


def batch_common_targets(df: DataFrame, batch: str = "batch", name: str = "name", pos: str = "pos") -> DataFrame:
    """Targets every usable file of a batch offers, in the first file's order; `merge` for several PDFs."""
    use = usable_files(df, name).select(batch, pos, ext_of(name).alias("ext"))
    # Everything about a file follows from its extension, so a batch shrinks to one row per extension
    # before targets are exploded, however many files it holds.
    per_ext = use.groupBy(batch, "ext").agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    totals = per_ext.groupBy(batch).agg(F.sum("n").alias("n_files"), F.count("*").alias("n_ext"),
                                        F.max(F.col("ext") != "pdf").alias("_other"))
    offered = (per_ext.select(batch, "first", F.posexplode(targets(F.col("ext"))).alias("at", "target"))
               .groupBy(batch, "target").agg(F.count("*").alias("k"), F.min_by("at", "first").alias("at")))
    common = (offered.join(totals.select(batch, "n_ext"), batch).filter(F.col("k") == F.col("n_ext"))
              .groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("at", "target"))).alias("_c")))
    merge = F.when((F.col("n_files") > 1) & ~F.col("_other"), str_array(["merge"])).otherwise(str_array([]))
    listed = F.concat(F.coalesce(F.transform("_c", lambda s: s["target"]), str_array([])), merge)
    return (totals.join(common, batch, "left").select(batch, "n_files", listed.alias("targets"))
            .withColumn("default_target", F.when(F.size("targets") == 1, F.col("targets")[0])))


def merge_eligibility(df: DataFrame, target: Column, batch: str = "batch", name: str = "name") -> DataFrame:
    """All-PDF and images-into-one-PDF flags per batch for a chosen `target` column."""
    ext = ext_of(name)
    use = usable_files(df, name)
    return (use.groupBy(batch).agg(
        F.count("*").alias("n_files"), F.bool_and(ext == "pdf").alias("all_pdf"),
        F.bool_and(ext.isin(R.CATEGORIES["image"][1])).alias("all_images"), F.max(target).alias("target"))
        .select(batch, "n_files", "all_pdf", "target",
                ((F.col("n_files") > 1) & (F.col("target") == "pdf") & F.col("all_images")).alias("images_to_one_pdf"))
        .withColumn("merging", (F.col("target") == "merge") | F.col("images_to_one_pdf")))


def target_group(t: Column) -> Column:
    return (F.when(t.isin(list(R.UPSCALE)), F.lit("upscale")).when(t.isin(list(R.TOOLS)), F.lit("tool"))
            .otherwise(F.lit("conversion")))


def target_label(t: Column) -> Column:
    up = lookup(str_map({k: f"고화질 {v}배" for k, v in R.UPSCALE.items()}), t)
    return F.coalesce(up, lookup(str_map(R.TOOLS), t), F.upper(t))


# --- signatures ---------------------------------------------------------------------------------

def head_is(content: Column, offset: int, hex_bytes: str) -> Column:
    n = len(hex_bytes) // 2
    return F.substring(content, offset + 1, n) == F.unhex(F.lit(hex_bytes))


def signature_check(df: DataFrame, content: str = "content", name: str = "name") -> DataFrame:
    """`ole`, and `damaged` when the head is not one of the kinds expected for the extension."""
    c = F.col(content)
    expected = F.split(lookup(str_map(R.EXPECTED), ext_of(name)), " ")
    kinds = {k: head_is(c, 0, h) for k, h in R.SIGNATURES.items()}
    ok = F.lit(False)
    for k, is_kind in kinds.items():
        ok = ok | (F.array_contains(expected, k) & is_kind)
    return (df.withColumn("ole", F.coalesce(kinds["ole"], F.lit(False)))
            .withColumn("damaged", F.coalesce(expected.isNotNull() & ~ok, F.lit(False))))


def sniffed_formats(content: Column) -> Column:
    """All formats whose leading bytes (or marker text) the content carries, in name order."""
    tests = [(fmt, head_is(content, off, hx)) for fmt, off, hx in R.MAGIC_AT]
    b0, b1 = (F.conv(F.hex(F.substring(content, i, 1)), 16, 10).cast("int") for i in (1, 2))
    sync = (b0 == 255)
    tests += [
        ("mp3", head_is(content, 0, "494433") | (sync & (b1.bitwiseAND(0xE0) == 0xE0))),
        ("aac", sync & (b1.bitwiseAND(0xF6) == 0xF0)),
        ("opus", head_is(content, 0, "4F676753") & F.contains(content, F.lit(b"OpusHead"))),
        ("mov", head_is(content, 4, "66747970") & head_is(content, 8, "7174")),
        ("avi", head_is(content, 0, "52494646") & head_is(content, 8, "41564920")),
        ("tiff", head_is(content, 0, "4D4D002A") | head_is(content, 0, "49492A00")),
    ]
    tests += [(fmt, F.contains(content, F.lit(text.encode()))) for fmt, text in R.MAGIC_TEXT.items()]
    return F.filter(F.array(*[F.when(cond, F.lit(fmt)) for fmt, cond in sorted(tests)]), lambda x: x.isNotNull())


def byte_pattern_scan(content: Column, needle: bytes = R.ENCRYPTION_MARKER.encode("utf-16-le")) -> Column:
    return F.contains(content, F.lit(needle))


def encryption_route(ole: Column, marked: Column, has_password: Column) -> Column:
    return (F.when(ole & marked & ~has_password, F.lit("needs_password"))
            .when(has_password & ole, F.lit("decrypt_first")).otherwise(F.lit("direct")))


def mime(ext: Column) -> Column:
    return lookup(str_map(R.MIME), ext)


# --- names ----------------------------------------------------------------------------------------

def tool_suffix(target: Column) -> Column:
    return F.coalesce(lookup(str_map({
        "compress": R.SUFFIX_COMPRESS, "rotr": R.SUFFIX_ROTATE, "rotl": R.SUFFIX_ROTATE,
        "unlock": R.SUFFIX_UNLOCK, "protect": R.SUFFIX_PROTECT, "merge": R.SUFFIX_MERGE}), target), F.lit(""))


def upscale_suffix(scale: Column, strength: Column, kind: Column) -> Column:
    return F.concat(F.lit("_고화질"), scale.cast("string"), F.lit("배"),
                    F.when(kind == "art", F.lit("_그림")).otherwise(F.lit("")),
                    F.coalesce(lookup(str_map(R.SUFFIX_STRENGTH), strength), F.lit("")))


def page_output_name(stem: Column, page: Column, n_pages: Column, ext: str, keep_single: bool) -> Column:
    """`stem-NN.ext`, padded to the digits of the page count; one rendered page carries no number."""
    numbered = F.concat(stem, F.lit("-"), F.lpad(page.cast("string"), F.length(n_pages.cast("string")), "0"))
    base = numbered if keep_single else F.when(n_pages == 1, stem).otherwise(numbered)
    return F.concat(base, F.lit(f".{ext}"))


_NUMBERED = r"^(.*) \((\d+)\)(\.[^.]+)$"


def unique_names(df: DataFrame, batch: str = "batch", name: str = "name", pos: str = "pos") -> DataFrame:
    """Resolve name collisions in batch order by ` (n)` before the extension, n = 2, 3, … until free.

    Names can only collide inside one chain: a name and its ` (n)` variants. Occurrences of a chain's
    base are numbered with the two-level row number. Variants that occur literally reserve their
    number if they come before the base reaches it; whether they do is decided from running counts,
    so no batch and no set of copies is ever gathered. Nested variants (`a (2) (2).txt`) repeat the
    step one level down; the levels present are read with one small aggregate.
    """
    has_ext = F.col(name).rlike(r"\.[^.]+$")
    # A name without an extension has no place for the number in front of it; it goes to the end.
    work = df.withColumn("_raw", F.when(has_ext, F.col(name)).otherwise(F.concat(name, F.lit("."))))
    level = F.size(F.regexp_extract_all(F.regexp_extract("_raw", r"((?: \(\d+\))*)\.[^.]*$", 1), F.lit(r"( \(\d+\))"), 1))
    work = ordered.cut(work.withColumn("_level", level).withColumn("_keeps", F.lit(True)))
    # First occurrences decide reservations; one row per distinct name and batch.
    depth = work.agg(F.max("_level")).first()[0] or 0
    done = None
    taken_firsts = None
    for lv in range(depth + 1):
        here = work.filter(F.col("_level") == lv)
        k = ordered.row_number(here, [batch, "_raw"], pos, "_k")
        if taken_firsts is not None:
            k = (k.join(taken_firsts, [batch, "_raw"], "left")
                 .withColumn("_keeps", ~F.coalesce(F.col("_lost"), F.lit(False))).drop("_lost"))
        # index of the occurrence among those that need a number: the first one keeps the plain name
        k = k.withColumn("_i", F.when(F.col("_keeps"), F.col("_k") - 1).otherwise(F.col("_k")))
        variants = (work.filter((F.col("_level") == lv + 1) & F.col("_raw").rlike(r" \([1-9]\d{0,17}\)\.[^.]*$"))
                    .groupBy(batch, "_raw").agg(F.min(pos).alias("_e"))
                    .select(batch, "_e", F.regexp_replace("_raw", r" \(\d+\)(\.[^.]*)$", "$1").alias("_base"),
                            F.regexp_extract("_raw", r" \((\d+)\)\.[^.]*$", 1).cast("long").alias("_n"))
                    .filter(F.col("_n") >= 2))
        # r: occurrences of the base (those needing a number) that come before the variant's first one
        marks = (k.filter(F.col("_i") >= 1).select(batch, F.col("_raw").alias("_base"), F.col(pos).alias("_p"),
                                                  F.lit(1).alias("_one"), F.lit(None).cast("long").alias("_n"))
                 .unionByName(variants.select(batch, "_base", F.col("_e").alias("_p"), F.lit(0).alias("_one"), "_n")))
        counted = ordered.running(marks, [batch, "_base"], "_p", {"_r": ("sum", F.col("_one"))})
        per_base = (counted.groupBy(batch, "_base").agg(
            F.sum("_one").alias("_total"),
            F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_n", "_r")))).alias("_v"))
            .filter(F.size("_v") > 0))
        # walk the variants by number; s = numbers already reserved by earlier ones
        step = F.aggregate(
            "_v", F.struct(F.lit(0).cast("long").alias("s"), F.expr("cast(array() as array<bigint>)").alias("at"),
                           F.expr("cast(array() as array<bigint>)").alias("lost")),
            lambda a, v: F.when((v["_r"] <= v["_n"] - 2 - a["s"]) | (v["_n"] - 1 - a["s"] > F.col("_total")),
                                F.struct((a["s"] + 1).alias("s"),
                                         F.array_append(a["at"], v["_n"] - 1 - a["s"]).alias("at"),
                                         a["lost"].alias("lost")))
            .otherwise(F.struct(a["s"].alias("s"), a["at"].alias("at"),
                                F.array_append(a["lost"], v["_n"]).alias("lost"))))
        solved = per_base.select(batch, "_base", step.alias("_w"))
        k = (k.join(solved.select(batch, F.col("_base").alias("_raw"), F.col("_w.at").alias("_at")), [batch, "_raw"], "left")
             .withColumn("_slot", F.when(F.col("_i") >= 1, F.col("_i") + 1 + F.coalesce(
                 F.size(F.filter("_at", lambda t: t <= F.col("_i"))), F.lit(0)))))
        final = F.when(F.col("_slot").isNull(), F.col("_raw")).otherwise(
            F.regexp_replace("_raw", r"(\.[^.]*)$", F.concat(F.lit(" ("), F.col("_slot").cast("string"), F.lit(")$1"))))
        out = k.select(*df.columns, F.regexp_replace(final, r"\.$", "").alias("unique_name"))
        done = out if done is None else done.unionByName(out)
        taken_firsts = solved.select(batch, F.col("_base"), F.explode("_w.lost").alias("_n")).select(
            batch, F.regexp_replace("_base", r"(\.[^.]*)$", F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")$1")))
            .alias("_raw"), F.lit(True).alias("_lost"))
    return done


# --- reports --------------------------------------------------------------------------------------

def pretty_mb(n: Column) -> Column:
    big = F.concat(F.format_number(F.expr("0") + n / 1e6, 1), F.lit("MB"))
    return (F.when(n >= 1e6, F.regexp_replace(big, ",", ""))
            .otherwise(F.concat(F.greatest(F.lit(1), js_round(n / 1e3)).cast("string"), F.lit("KB"))))


def pretty_size(n: Column) -> Column:
    def scaled(k: int, unit: str) -> Column:
        return F.concat(F.regexp_replace(F.format_number(n / float(1024 ** k), 1), ",", ""), F.lit(f" {unit}"))
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 ** 2, scaled(1, "KB"))
            .when(n < 1024 ** 3, scaled(2, "MB")).otherwise(scaled(3, "GB")))


def compression_report(df: DataFrame, size_in: str, size_out: str) -> DataFrame:
    a, b = F.col(size_in), F.col(size_out)
    kept = b >= a * 0.97
    pct = js_round((F.lit(1.0) - b / a) * 100).cast("string")
    note = F.concat(pretty_mb(a), F.lit(" → "), pretty_mb(b), F.lit(" ("), pct, F.lit("% 줄임)"))
    return (df.withColumn("keep_original", kept)
            .withColumn("note", F.when(kept, F.lit(R.NOTE_ALREADY_SMALL)).otherwise(note)))


def batch_summary(df: DataFrame, batch: str = "batch", size: str = "size") -> DataFrame:
    return df.groupBy(batch).agg(F.count("*").alias("n_files"), F.sum(size).alias("total_size"))


def outcome_summary(jobs: DataFrame, batch: str) -> DataFrame:
    """Counts and class per batch from rows with nullable `error`, `note`, `warning`."""
    n, bad = F.col("n_jobs"), F.col("n_errors")
    return (jobs.groupBy(batch).agg(F.count("*").alias("n_jobs"), F.count("error").alias("n_errors"),
                                    F.count("note").alias("n_notes"), F.count("warning").alias("n_warnings"))
            .withColumn("n_done", n - bad)
            .withColumn("outcome", F.when(bad == n, F.lit("failed")).when(bad > 0, F.lit("partial"))
                        .otherwise(F.lit("complete"))))


def outcome_lines(jobs: DataFrame, batch: str, pos: str, label: str = "label") -> DataFrame:
    """The report text of each batch as numbered rows: errors, then notes, then warnings, each in job order.
    Rows instead of one string keep a large batch distributed."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("section"), F.col(c).alias("text"))
                                for i, c in enumerate(("error", "note", "warning"))]))
    rows = (jobs.select(batch, pos, label, parts.alias("p")).filter("p.text is not null")
            .select(batch, pos, F.col("p.section"), F.concat(label, F.lit(": "), F.col("p.text")).alias("line")))
    return ordered.row_number(rows, [batch, "section"], pos, "line_no").drop(pos)


def classify_error(stage: Column, message: Column, had_password: Column) -> Column:
    """load / password_wrong / password_needed / convert, judged in that order."""
    return (F.when((stage == "load") | message.rlike(R.LOAD_FAILURE), F.lit("load"))
            .when(message.rlike(r"(?i)password|PASSWORD_REQUIRED"),
                  F.when(had_password, F.lit("password_wrong")).otherwise(F.lit("password_needed")))
            .when(message.isNull() | (message == ""), F.lit("unknown")).otherwise(F.lit("convert")))


# --- media ----------------------------------------------------------------------------------------

def first_lines(logs: DataFrame, job: str = "job", seq: str = "seq", line: str = "line") -> DataFrame:
    """First video, audio and duration line of each job."""
    text = F.col(line)

    def first_match(pattern: str) -> Column:
        return F.min_by(F.when(text.rlike(pattern), text), F.when(text.rlike(pattern), F.col(seq)))
    return logs.groupBy(job).agg(first_match(r"Stream #.*Video:").alias("video"),
                                 first_match(r"Stream #.*Audio:").alias("audio"),
                                 first_match(r"Duration: \d+:\d+:[\d.]+").alias("duration_line"))


def media_plan(firsts: DataFrame) -> DataFrame:
    v = F.regexp_extract("video", r"Video: (\w+)", 1)
    a = F.regexp_extract("audio", r"Audio: (\w+)", 1)
    h264 = (v == "h264") & F.col("video").rlike(r"yuvj?420p[(,\s]")
    no_audio = F.col("audio").isNull() | (a == "")
    return (firsts.withColumn("copy_video", F.coalesce(h264 | (v == "hevc"), F.lit(False)))
            .withColumn("tag", F.when(v == "hevc", F.lit("hvc1")))
            .withColumn("copy_audio", no_audio | F.coalesce(a.isin("aac", "mp3"), F.lit(False)))
            .withColumn("webm_copy", F.coalesce(F.col("video").rlike("Video: (vp8|vp9|av1)"), F.lit(False))
                        & (F.col("audio").isNull() | F.col("audio").rlike("Audio: (opus|vorbis)"))))


def parse_media_log(firsts: DataFrame) -> DataFrame:
    def part(i: int) -> Column:
        return F.try_element_at(F.regexp_extract_all("duration_line", F.lit(r"Duration: (\d+):(\d+):(\d+(?:\.\d+)?)"),
                                                     F.lit(i)), F.lit(1)).cast("double")
    fps = F.coalesce(F.nullif(F.regexp_extract("video", r"(\d+(?:\.\d+)?) fps", 1), F.lit("")),
                     F.nullif(F.regexp_extract("video", r"(\d+(?:\.\d+)?) tbr", 1), F.lit("")))
    good = (fps.cast("double") > 0) & (fps.cast("double") <= 120)
    return (firsts.withColumn("duration", F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0.0)))
            .withColumn("fps", F.when(F.col("video").isNotNull(), F.when(good, fps).otherwise(F.lit("30"))))
            .withColumn("kbps", F.nullif(F.regexp_extract("audio", r"(\d+) kb/s", 1), F.lit("")).cast("int"))
            .withColumn("has_audio", F.col("audio").isNotNull()))


def conversion_rule(cat: Column, ext: Column, target: Column) -> tuple[Column, Column]:
    """(output extension, arguments) of a media conversion; shrinking audio falls back to MP3."""
    shrink = target == "compress"
    audio_to = F.coalesce(lookup(str_map({k: v[0] for k, v in R.SHRINK_AUDIO.items()}), ext), F.lit(R.SHRINK_AUDIO_OTHER[0]))
    audio_args = F.coalesce(lookup(str_map({k: v[1] for k, v in R.SHRINK_AUDIO.items()}), ext), F.lit(R.SHRINK_AUDIO_OTHER[1]))
    to = F.when(~shrink, target).when(cat == "video", F.lit("mp4")).otherwise(audio_to)
    args = (F.when(shrink & (cat == "video"), F.lit(R.SHRINK_VIDEO_ARGS)).when(shrink, audio_args)
            .when(target == "mov", F.lit(R.MEDIA_ARGS["mp4"])).otherwise(lookup(str_map(R.MEDIA_ARGS), target)))
    return to, args


def log_tail(logs: DataFrame, job: str = "job", seq: str = "seq", keep: int = 200) -> DataFrame:
    """Last lines per job; the group limit is applied before and after the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy(job).orderBy(F.col(seq).desc())
    return logs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


# --- sizes ----------------------------------------------------------------------------------------

def shrink_video_size(w: Column, h: Column) -> tuple[Column, Column]:
    k = F.least(F.lit(1.0), F.try_divide(F.lit(float(R.SHRINK_LONG)), F.greatest(w, h)), F.try_divide(F.lit(float(R.SHRINK_SHORT)), F.least(w, h)))
    return tuple(F.greatest(F.lit(2), js_round((x * k) / 2) * 2) for x in (w, h))


def canvas_size(w: Column, h: Column, limit: float = R.MAX_PIXELS) -> tuple[Column, Column]:
    k = F.least(F.lit(1.0), F.sqrt(F.try_divide(F.lit(float(limit)), w * h)))
    return tuple(F.greatest(F.lit(1), js_round(x * k)) for x in (w, h))


def photo_size(w: Column, h: Column) -> tuple[Column, Column]:
    k = F.least(F.lit(1.0), F.try_divide(F.lit(float(R.PHOTO_LONG)), F.greatest(w, h)))
    return tuple(F.greatest(F.lit(1), js_round(x * k)) for x in (w, h))


def upscaled_video_size(w: Column, h: Column, scale: Column) -> tuple[Column, Column]:
    k = F.least(scale.cast("double"), F.sqrt(F.try_divide(F.lit(float(R.VIDEO_LONG * R.VIDEO_SHORT)), w * h)),
                F.try_divide(F.lit(float(R.VIDEO_LONG)), F.greatest(w, h)), F.try_divide(F.lit(float(R.VIDEO_SHORT)), F.least(w, h)))
    sizes = [F.greatest(F.lit(1), js_round(x * k)) for x in (w, h)]
    return tuple(s - s % 2 for s in sizes)


def upscaled_image_factor(w: Column, h: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(scale.cast("double"), F.sqrt(F.try_divide(F.lit(float(R.MAX_PIXELS)), w * h))))


def upscaled_image_size(w: Column, h: Column, scale: Column) -> tuple[Column, Column]:
    k = upscaled_image_factor(w, h, scale)
    return tuple(F.greatest(x.cast("long"), js_round(x * k)) for x in (w, h))


def upscale_steps(k: Column) -> Column:
    """Steps of an enlargement with their cost and the progress share reached at their end."""
    steps = F.when(k > 4, F.array(k / 4, k)).otherwise(F.array(k))
    cost = F.transform(steps, lambda s, i: F.when(i == 0, F.lit(1.0)).otherwise(F.element_at(steps, 1) * F.element_at(steps, 1)))
    total = F.aggregate(cost, F.lit(0.0), lambda a, c: a + c)
    return F.transform(steps, lambda s, i: F.struct(
        (i + 1).alias("step"), s.alias("factor"), F.get(cost, i).alias("cost"),
        (F.aggregate(F.slice(cost, F.lit(1), i + 1), F.lit(0.0), lambda a, c: a + c) / total).alias("progress")))


def rotate_metadata(df: DataFrame, angle: str, add: Column, w: str, h: str, ext: str) -> DataFrame:
    turn = add % 180 != 0
    return (df.withColumn("new_angle", F.pmod(F.col(angle) + add, F.lit(360)))
            .withColumn("new_w", F.when(turn, F.col(h)).otherwise(F.col(w)))
            .withColumn("new_h", F.when(turn, F.col(w)).otherwise(F.col(h)))
            .withColumn("new_ext", F.coalesce(lookup(str_map(R.ROTATED), ext), F.lit("png"))))


def css_px(value: Column) -> Column:
    """Length with a CSS unit in pixels, 0 when it cannot be read."""
    pattern = r"(?i)^\s*([\d.]+)\s*(px|pt|pc|mm|cm|in)?\s*$"
    unit = F.lower(F.regexp_extract(value, pattern, 2))
    factor = F.when(unit == "", F.lit(1.0))
    for u, f in R.CSS_UNITS.items():
        factor = factor.when(unit == u, F.lit(f))
    return F.coalesce(F.regexp_extract(value, pattern, 1).try_cast("double") * factor, F.lit(0.0))


def css_size(width: Column, height: Column, view_box: Column) -> tuple[Column, Column]:
    w, h = css_px(width), css_px(height)
    box = F.split(F.coalesce(view_box, F.lit("")), r"[\s,]+")
    bw, bh = F.get(box, F.lit(2)).try_cast("double"), F.get(box, F.lit(3)).try_cast("double")
    has_box = F.coalesce((F.size(box) == 4) & (bw > 0) & (bh > 0), F.lit(False))
    out_w = (F.when((w == 0) & (h == 0), F.when(has_box, bw).otherwise(F.lit(300.0)))
             .when(w == 0, F.when(has_box, h * bw / bh).otherwise(h)).otherwise(w))
    out_h = (F.when((w == 0) & (h == 0), F.when(has_box, bh).otherwise(F.lit(150.0)))
             .when(h == 0, F.when(has_box, w * bh / bw).otherwise(w)).otherwise(h))
    return out_w, out_h


def paper_size(px: Column) -> Column:
    return px * 72 / 150


def layout_points(px: Column) -> Column:
    return px * 0.75


def quality_profile(df: DataFrame, ext: str, strength: str) -> DataFrame:
    strict = F.col(ext).isin(R.LOSSLESS) | (F.col(strength) == "original")
    return (df.withColumn("core", F.when(strict, F.lit(0.0)).otherwise(F.lit(0.015)))
            .withColumn("soft", F.when(strict, 0).otherwise(1))
            .withColumn("sharp", F.when(F.col(strength) == "strong", F.lit(1.0)).otherwise(F.lit(0.0))))


# --- manifests, dedupe, pages, routes --------------------------------------------------------------

def verify_manifest(files: DataFrame, manifest: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Manifest rows (`name`, `sha256`) judged against file contents: ok / mismatch / missing."""
    have = files.select(F.col(name).alias("name"), F.sha2(content, 256).alias("_sha"), F.length(content).alias("size"))
    return (manifest.join(have, "name", "left")
            .withColumn("status", F.when(F.col("_sha").isNull(), F.lit("missing"))
                        .when(F.col("_sha") == F.col("sha256"), F.lit("ok")).otherwise(F.lit("mismatch")))
            .select("name", "status", "size"))


def incremental_select(src: DataFrame, out: DataFrame, key: str, mtime: str = "mtime") -> DataFrame:
    """Sources whose output is missing or older."""
    o = out.select(key, F.col(mtime).alias("_o"))
    return src.join(o, key, "left").filter(F.col("_o").isNull() | (F.col("_o") < F.col(mtime))).drop("_o")


def fingerprint_dedupe(df: DataFrame, content: str, order: str) -> DataFrame:
    """Treat contents as equal on (length, byte 100, middle byte); keep the first."""
    c = F.col(content)
    keyed = df.select(*df.columns, F.length(c).alias("_n"), F.hex(F.substring(c, 101, 1)).alias("_b"),
                      F.hex(c.substr(F.floor(F.length(c) / 2).cast("int") + 1, F.lit(1))).alias("_m"))
    return dedupe_files(keyed, ["_n", "_b", "_m"], order).select(*df.columns)


def merge_pages(pages: DataFrame, doc: str, page: str, batch: str, pos: str) -> DataFrame:
    """Pages of a batch renumbered through its documents in list order. Only page counts are ordered;
    the offset of each document is then added to its pages."""
    docs = pages.groupBy(batch, doc, pos).agg(F.count("*").alias("_n"))
    run = ordered.running(docs, [batch], pos, {"_upto": ("sum", F.col("_n"))})
    offs = run.select(F.col(batch), F.col(doc), (F.col("_upto") - F.col("_n")).alias("_off"))
    return pages.join(offs, [batch, doc]).withColumn("merged_page", F.col("_off") + F.col(page) + 1).drop("_off")


def conversion_path(engine_id: Column, target: Column) -> Column:
    """Hops of a conversion with their share of the progress bar."""
    kind = F.when(target.isin("jpg", "png"), F.lit("image")).otherwise(target)

    def hops(parts):
        return F.array(*[F.struct(F.when(F.lit(a) == "image", target).otherwise(F.lit(a)).alias("src"),
                                  F.when(F.lit(b) == "image", target).otherwise(F.lit(b)).alias("dst"),
                                  F.lit(s).alias("share")) for a, b, s in parts])
    out = F.array(F.struct(engine_id.alias("src"), target.alias("dst"), F.lit(1.0).alias("share")))
    for eng, k, parts in reversed(R.ROUTES):
        out = F.when((engine_id == eng) & (kind == k), hops(parts)).otherwise(out)
    return out


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("first_rule", "R", "F")]
