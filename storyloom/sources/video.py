"""Video at the edge of the engine: metadata and frames, decoded on the executors by a function that is passed in.

Which frames to take is planned in tables (``plans.sampling``). The default decoder needs OpenCV, which is imported in the
worker; any object with ``fps``, ``frames`` and ``read(index) -> bytes`` will do.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _OpenCv:
    def __init__(self, path: str):
        import cv2

        self._cv2, self._video = cv2, cv2.VideoCapture(path)
        if not self._video.isOpened():
            raise ValueError(f"can't open {path}")
        self.fps, self.frames = float(self._video.get(cv2.CAP_PROP_FPS)), int(self._video.get(cv2.CAP_PROP_FRAME_COUNT))

    def read(self, index: int) -> bytes:
        self._video.set(self._cv2.CAP_PROP_POS_FRAMES, index)
        ok, frame = self._video.read()
        if not ok:
            raise ValueError(f"can't read frame {index}")
        return self._cv2.imencode(".jpg", frame)[1].tobytes()


def _encode_mp4(images: Iterator[bytes], fps: float, path: str) -> None:
    """MP4 of JPEG images, one in memory at a time."""
    import cv2
    import numpy as np

    out = None
    for image in images:
        frame = cv2.imdecode(np.frombuffer(image, np.uint8), cv2.IMREAD_COLOR)
        if out is None:
            out = cv2.VideoWriter(path, cv2.VideoWriter_fourcc(*"mp4v"), fps, (frame.shape[1], frame.shape[0]))
        out.write(frame)
    if out is not None:
        out.release()


def _draw_sheet(images: list[bytes], columns: int = 4, width: int = 320) -> bytes:
    """One JPEG of thumbnails in rows."""
    import cv2
    import numpy as np

    small = [cv2.imdecode(np.frombuffer(i, np.uint8), cv2.IMREAD_COLOR) for i in images]
    height = max(1, round(width * small[0].shape[0] / small[0].shape[1]))
    small = [cv2.resize(i, (width, height)) for i in small]
    small += [np.zeros_like(small[0])] * (-len(small) % columns)
    return cv2.imencode(".jpg", np.vstack([np.hstack(small[i : i + columns]) for i in range(0, len(small), columns)]))[1].tobytes()


def placed(target: str, write: Callable[[str], None]) -> None:
    """``write`` to a name of its own beside the target, then rename: a task that is run again leaves no half of a file."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    stem, ext = os.path.splitext(target)
    part = f"{stem}.{uuid.uuid4().hex}{ext}"
    try:
        write(part)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.remove(part)


def _save(image: bytes) -> Callable[[str], None]:
    def write(path: str) -> None:
        with open(path, "wb") as f:
            f.write(image)

    return write


def video_metadata(paths: DataFrame, open_video: Callable[[str], object] = _OpenCv) -> DataFrame:
    """``(path, fps, frames, duration_sec)`` of ``paths(path)``; a video without a frame rate is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                v = open_video(path)
                if v.fps <= 0:
                    raise ValueError(f"{path} has no frame rate")
                rows.append((path, float(v.fps), int(v.frames), v.frames / v.fps))
            yield pd.DataFrame(rows, columns=["path", "fps", "frames", "duration_sec"])

    return paths.select("path").mapInPandas(run, "path string, fps double, frames long, duration_sec double")


def frames_at(plan: DataFrame, open_video: Callable[[str], object] = _OpenCv) -> DataFrame:
    """``plan(path, frame_index, ...)`` with ``image``; rows of a video are dealt together so that it's opened once a task, indexes beyond its end take the last frame."""
    schema = plan.withColumn("image", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, object] = {}
        for batch in batches:
            images = []
            for path, index in zip(batch["path"], batch["frame_index"]):
                if path not in held:
                    held = {path: open_video(path)}
                images.append(held[path].read(max(0, min(int(index), held[path].frames - 1))))
            yield batch.assign(image=images)

    return plan.repartition("path", F.floor(F.col("frame_index") / 1000)).sortWithinPartitions("path", "frame_index").mapInPandas(run, schema)


def continuous_frames(windows: DataFrame, fps: float) -> DataFrame:
    """One row for each frame of ``windows(path, window_start_sec, window_end_sec, ...)``, both ends included."""
    first, last = (F.rint(F.col(c) * fps).cast("int") for c in ("window_start_sec", "window_end_sec"))
    return windows.withColumn("frame_index", F.explode(F.sequence(first, F.greatest(first, last))))


def contact_sheets(frames: DataFrame, keys: list[str], per_sheet: int = 20) -> DataFrame:
    """The images of each key on sheets of ``per_sheet``, in order of ``sample_index``."""
    return frames.withColumn("sheet", F.floor(F.col("sample_index") / per_sheet).cast("int")).groupBy(*keys, "sheet").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample_index", "frame_index"))), lambda s: s["frame_index"]).alias("frame_indices")
    )


def write_frames(frames: DataFrame) -> DataFrame:
    """``(output_path, bytes)``: writes ``image`` of ``frames(image, output_path)`` on the executors; the folder must be one that all machines share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, target in zip(batch["image"], batch["output_path"]):
                placed(target, _save(bytes(image)))
            yield pd.DataFrame({"output_path": batch["output_path"], "bytes": [len(i) for i in batch["image"]]})

    return frames.select("image", "output_path").mapInPandas(run, "output_path string, bytes long")


def write_clips(clips: DataFrame, open_video: Callable[[str], object] = _OpenCv, encode: Callable[[Iterator[bytes], float, str], None] = _encode_mp4) -> DataFrame:
    """``(output_path, fps, frames)``: one clip of each row of ``clips(path, first_frame, last_frame, output_path)``, both ends included, frames read one by one.

    Frames outside the video are left out: a clip that begins beyond its end has the last frame alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, first, last, target in zip(batch["path"], batch["first_frame"], batch["last_frame"], batch["output_path"]):
                video = open_video(path)
                first = max(0, min(int(first), video.frames - 1))
                last = max(first, min(int(last), video.frames - 1))
                placed(target, lambda part: encode((video.read(i) for i in range(first, last + 1)), float(video.fps), part))
                rows.append((target, float(video.fps), last - first + 1))
            yield pd.DataFrame(rows, columns=["output_path", "fps", "frames"])

    return clips.select("path", "first_frame", "last_frame", "output_path").mapInPandas(run, "output_path string, fps double, frames long")


def write_sheets(sheets: DataFrame, open_video: Callable[[str], object] = _OpenCv, draw: Callable[[list[bytes]], bytes] = _draw_sheet) -> DataFrame:
    """``(output_path, frames)``: the image of each row of ``sheets(path, frame_indices, output_path)``, as ``contact_sheets`` makes them; at most a sheet's frames are in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, indices, target in zip(batch["path"], batch["frame_indices"], batch["output_path"]):
                video = open_video(path)
                placed(target, _save(draw([video.read(max(0, min(int(i), video.frames - 1))) for i in indices])))
            yield pd.DataFrame({"output_path": batch["output_path"], "frames": [len(i) for i in batch["frame_indices"]]})

    return sheets.select("path", "frame_indices", "output_path").mapInPandas(run, "output_path string, frames long")
