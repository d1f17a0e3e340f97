"""Frames and review windows: which moments of a segment to look at, and which stored frame shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.numeric import rounded
from storyloom.functions.text import clock, file_slug
from storyloom.operators.joins import nearest
from storyloom.operators.sequences import top_rows

STRATEGIES = ("uniform", "first_middle_last")


def sample_times(start: Column, end: Column, n: int, strategy: str = "uniform") -> Column:
    """``n`` moments of a segment; one alone is its middle."""
    if n <= 0:
        raise ValueError("the number of samples must be positive")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    middle = start + (end - start) / 2.0
    if n == 1:
        return F.array(middle)
    if strategy == "uniform":
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * ((end - start) / float(n - 1)))
    return F.array(*[start, middle, end, *[middle] * max(0, n - 3)][:n])


def frame_index(seconds: Column, fps: float, base: int = 0) -> Column:
    """Rounded half to even."""
    return F.rint(seconds * fps).cast("int") + base


def sample_frames(segments: DataFrame, frames: DataFrame, fps: float, base: int = 0, per_segment: int = 6, strategy: str = "uniform", out_dir: str = "") -> DataFrame:
    """One row for each sample: the target index, the nearest stored frame and where its copy would go.

    ``frames(story_id, frame_index, path)`` has an index once. Copying is left to the caller.
    """
    if fps <= 0:
        raise ValueError("fps must be positive")
    rows = segments.where("segment_end_sec >= segment_start_sec").select(
        "story_id", "segment_id", "object_id", "canonical_name", F.posexplode(sample_times(F.col("segment_start_sec"), F.col("segment_end_sec"), per_segment, strategy)).alias("sample_index", "time")
    ).withColumn("target_frame_index", frame_index(F.col("time"), fps, base))
    met = nearest(rows, frames, "target_frame_index", "frame_index", ["story_id"], "found")
    named = met.join(frames.select("story_id", F.col("frame_index").alias("found"), F.col("path").alias("source_path")), ["story_id", "found"], "left")
    ext = F.lower(F.regexp_extract("source_path", r"(\.[^./\\]*)$", 1))
    return named.select(
        "story_id", "segment_id", "object_id", "canonical_name", "sample_index", rounded(F.col("time"), 3).alias("timestamp_sec"), "target_frame_index", F.col("found").alias("frame_index"), "source_path",
        F.concat(F.lit(out_dir and f"{out_dir.rstrip('/')}/"), "segment_id", F.format_string("/sample_%02d_f%06d", "sample_index", "found"), ext).alias("output_path"),
    )


def select_segments(segments: DataFrame, object_id: str | None = None, segment_id: str | None = None) -> DataFrame:
    """Each object's best segment: highest priority, then confidence, then earliest start; of one object, or the segment of that name, if given."""
    if object_id is not None:
        segments = segments.where(F.col("object_id") == object_id)
    if segment_id is not None:
        segments = segments.where(F.col("segment_id") == segment_id)
    return top_rows(segments, ["story_id", "object_id"], [F.desc("priority_score"), F.desc("alignment_confidence_max"), F.asc("segment_start_sec"), F.asc("segment_id")], 1)


def centered_window(start: Column, end: Column, radius_sec: float, center: Column | None = None, duration: Column | None = None) -> Column:
    """A review window about the middle of a segment or a given centre, within the film if its length is known."""
    if radius_sec <= 0:
        raise ValueError("the radius must be positive")
    mid = (start + end) / 2.0 if center is None else center
    low, high = mid - radius_sec, mid + radius_sec
    if duration is not None:
        low, high = F.greatest(F.lit(0.0), low), F.least(duration, high)
    return _window(mid, low, high)


def _window(mid: Column, low: Column, high: Column) -> Column:
    return F.struct(
        rounded(mid, 3).alias("center_sec"), rounded(low, 3).alias("window_start_sec"), rounded(high, 3).alias("window_end_sec"), clock(low).alias("window_start_hhmmss"), clock(high).alias("window_end_hhmmss")
    )


def explicit_window(start: Column, end: Column, duration: Column | None = None) -> Column:
    """A given window, within the film if its length is known; null where nothing is left."""
    low, high = (start, end) if duration is None else (F.greatest(F.lit(0.0), start), F.least(duration, end))
    return F.when((end > start) & (high > low), _window((low + high) / 2.0, low, high))


def dense_times(start: Column, end: Column, every_sec: float) -> Column:
    """Moments every so often from start, and the end if it isn't among them."""
    if every_sec <= 0:
        raise ValueError("the step must be positive")
    count = F.floor((end - start) / every_sec).cast("int")
    times = F.transform(F.sequence(F.lit(0), count), lambda i: rounded(start + i * every_sec, 3))
    return F.when(end == start, F.array(rounded(start, 3))).when(F.abs(F.element_at(times, -1) - end) > 1e-3, F.concat(times, F.array(rounded(end, 3)))).otherwise(times)


def _moments(windows: DataFrame, keys: list[str], every_sec: float, fps: float, duration_sec: float) -> DataFrame:
    """The moments of each window ``w``, their video frames within the film, and the sheet of 20 each goes to."""
    moments = windows.select(*keys, "w", F.posexplode(dense_times(F.col("w.window_start_sec"), F.col("w.window_end_sec"), every_sec)).alias("sample_index", "timestamp_sec"))
    return moments.select(
        *keys, "w.*", "sample_index", "timestamp_sec", F.least(frame_index(F.col("timestamp_sec"), fps), F.lit(max(int(duration_sec * fps) - 1, 0))).alias("frame_index"),
        F.floor(F.col("sample_index") / 20).cast("int").alias("sheet"),
    )


def review_plan(
    segments: DataFrame, radius_sec: float, every_sec: float, fps: float, duration_sec: float, object_id: str | None = None, segment_id: str | None = None, center_sec: float | None = None
) -> DataFrame:
    """For each object's best segment, or the one named, its review window (about ``center_sec`` if given) and the moments to look at."""
    center = None if center_sec is None else F.lit(float(center_sec))
    best = select_segments(segments, object_id, segment_id).withColumn("w", centered_window(F.col("segment_start_sec"), F.col("segment_end_sec"), radius_sec, center, F.lit(float(duration_sec))))
    return _moments(best, ["story_id", "object_id", "segment_id"], every_sec, fps, duration_sec)


def explicit_plan(windows: DataFrame, fps: float, duration_sec: float, every_sec: float = 0.5) -> DataFrame:
    """The moments to look at of ``windows(label, start_sec, end_sec)`` set by hand; a window with nothing left within the film has none."""
    set_by_hand = windows.withColumn("w", explicit_window(F.col("start_sec"), F.col("end_sec"), F.lit(float(duration_sec)))).where("w is not null")
    return _moments(set_by_hand, ["label"], every_sec, fps, duration_sec)


def clip_plan(windows: DataFrame, fps: float, duration_sec: float, out_dir: str) -> DataFrame:
    """``(label, window, first_frame, last_frame, output_path)``: the clip of each window set by hand, both end frames included."""
    set_by_hand = windows.withColumn("w", explicit_window(F.col("start_sec"), F.col("end_sec"), F.lit(float(duration_sec)))).where("w is not null")
    last = max(int(duration_sec * fps) - 1, 0)
    at = lambda c: F.least(frame_index(F.col(f"w.{c}"), fps), F.lit(last))
    return set_by_hand.select("label", "w.*", at("window_start_sec").alias("first_frame"), at("window_end_sec").alias("last_frame"), F.concat(F.lit(f"{out_dir.rstrip('/')}/clip/"), file_slug(F.col("label")), F.lit(".mp4")).alias("output_path"))
