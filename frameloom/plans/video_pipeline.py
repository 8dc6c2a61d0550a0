"""From videos to detections with embeddings: sampled frames, sharpness, detection, the largest faces, crops, embedding.

The step over frames keeps no state, so that it runs on a table or a stream of frames alike. Models are made once in each
task, by functions that are handed in, and are checked before the first frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from frameloom import schemas
from frameloom.functions import pixels
from frameloom.operators.gates import FRAME_BLUR, PER_FRAME
from frameloom.plans import face_pipeline
from frameloom.sources import media

OBSERVED = f"{schemas.DETECTIONS}, embedding array<float>"
COLUMNS = [x.split()[0] for x in OBSERVED.split(", ")]


class Embedder(Protocol):
    """A model: the shape of its input (batch, side, side, channels), the size of its output, and embed(values) -> vector."""

    shape: tuple[int, int, int, int]
    dim: int

    def embed(self, values: np.ndarray) -> np.ndarray: ...


def checked(model: Embedder) -> Embedder:
    shape = tuple(model.shape)
    if len(shape) != 4 or shape[1] != shape[2] or shape[3] != 3:
        raise ValueError(f"an embedder takes square images of three channels, not {shape}")
    if model.dim <= 0:
        raise ValueError("an embedder gives vectors of one number or more")
    return model


def observed(frames: DataFrame, make_detector: Callable[[], Callable[[np.ndarray], list[dict]]], make_embedder: Callable[[], Embedder], frame_blur: float = FRAME_BLUR, per_frame: int = PER_FRAME) -> DataFrame:
    """The detections table with embedding, of frames. A detector takes an image and gives faces as dicts of the table's
    columns. Of a blurred frame nothing is detected; of another the largest faces are embedded, cropped and turned upright."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect, model = make_detector(), checked(make_embedder())
        for batch in batches:
            out = []
            for r in batch.itertuples():
                image = np.asarray(r.gray, np.int64).reshape(r.h, r.w)
                frame_sharp = pixels.sharpness_of(image)
                faces = detect(image) if frame_sharp >= frame_blur else []
                size = lambda x: max(0, min(x["right"], r.w) - max(x["left"], 0)) * max(0, min(x["bottom"], r.h) - max(x["top"], 0))  # noqa: E731, B023
                for k, face in sorted(enumerate(faces), key=lambda x: (-size(x[1]), x[0]))[: max(1, per_frame)]:
                    box = tuple(face[x] for x in ("left", "top", "right", "bottom"))
                    if box[2] <= box[0] or box[3] <= box[1]:
                        continue
                    crop = pixels.face_crop(image, pixels.embed_square(box, r.w, r.h), face.get("euler_z") or 0.0, model.shape[1])
                    vector = np.asarray(model.embed(pixels.model_input(np.repeat(crop[..., None], 3, 2))), np.float32)
                    if len(vector) != model.dim:
                        raise ValueError(f"an embedder of {model.dim} numbers gave {len(vector)}")
                    length = float(np.sqrt((vector * vector).sum()))
                    own = {"video_id": r.video_id, "frame_idx": r.frame_idx, "ts_ms": r.ts_ms, "frame_sharp": frame_sharp, "det_idx": k, "face_sharp": pixels.sharpness_of(image, box), "frame_w": r.w, "frame_h": r.h}
                    out.append(face | own | {"embedding": (vector / length if length > 1e-9 else vector).tolist()})
            yield pd.DataFrame(out, columns=COLUMNS)

    return frames.select("video_id", "frame_idx", "ts_ms", "w", "h", "gray").mapInPandas(rows, OBSERVED)


def run(videos: DataFrame, decode: Callable, make_detector: Callable, make_embedder: Callable) -> dict[str, DataFrame]:
    """From the videos table to samples, members, people, best shots and summary."""
    return face_pipeline.run(observed(media.sampled_frames(media.checked(videos), decode), make_detector, make_embedder))
