"""PCM audio as frames of samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def pcm_frames(files: DataFrame, frame: int = 1024) -> DataFrame:
    """Vid, frame, rate, samples of 16-bit WAV contents (vid, content): the mean of all channels, in [-1, 1).

    Files are read frame by frame within a task; contents that are no 16-bit WAV give no rows. For files,
    read them with the ``binaryFile`` format and name a key.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for vid, content in zip(pdf["vid"], pdf["content"]):
                try:
                    reader = wave.open(io.BytesIO(content), "rb")
                except (wave.Error, EOFError):
                    continue
                if reader.getsampwidth() != 2:
                    continue
                number = 0
                while data := reader.readframes(frame):
                    x = np.frombuffer(data, "<i2").reshape(-1, reader.getnchannels()).mean(axis=1) / 32768
                    yield pd.DataFrame({"vid": [vid], "frame": [number], "rate": [reader.getframerate()], "samples": [x]})
                    number += 1

    return files.select("vid", "content").mapInPandas(each, "vid bigint, frame bigint, rate int, samples array<double>")
