"""Probes of images, audio and video: codecs, rates, tolerances, levels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signatures import mapped

# Codec aliases; samples in a frame of lossy codecs.
CODEC_ALIAS = {"mp4a": "aac", "avc1": "h264", "mpeg4/iso/avc": "h264"}
FRAME_SAMPLES = {"mp3": 1152, "aac": 1024, "alac": 4096, "opus": 960, "vorbis": 1024, "ac3": 1536}


def codec(name: Column) -> Column:
    """A codec's plain name: prefixes a_, v_ and lib off, in that order, aliases resolved."""
    low = F.lower(F.coalesce(name, F.lit("")))
    for prefix in ("a_", "v_", "lib"):
        low = F.when(low.startswith(prefix), F.substring(low, len(prefix) + 1, 1000)).otherwise(low)
    return F.coalesce(mapped(low, CODEC_ALIAS), low)


def bits_per_second(rate: Column) -> Column:
    """'2000k', '2M', '128000 bps' as a number; null if it is none."""
    low = F.lower(F.trim(rate))
    number = F.regexp_extract(low, r"^([0-9]+(?:\.[0-9]+)?) *([km]?)(?:bps|bit/s)?$", 1)
    unit = F.regexp_extract(low, r"^([0-9]+(?:\.[0-9]+)?) *([km]?)(?:bps|bit/s)?$", 2)
    return F.when(number != "", F.floor(number.cast("double") * F.when(unit == "k", 1000).when(unit == "m", 1000000).otherwise(1)).cast("long"))


def duration_tolerance(tracks: Column, video: Column) -> Column:
    """Seconds that durations may differ: 10 ms or the longest audio frame of tracks (struct<codec, sample_rate>); with video, 50 ms at least."""
    frame = F.transform(tracks, lambda t: F.coalesce(mapped(codec(t["codec"]), FRAME_SAMPLES).cast("double"), F.lit(0.0)) / F.coalesce(t["sample_rate"], F.lit(48000)))
    audio = F.greatest(F.lit(0.010), F.coalesce(F.array_max(frame), F.lit(0.0)))
    return F.when(video, F.greatest(audio, F.lit(0.050))).otherwise(audio)


def effective_rate(declared: Column, size: Column, seconds: Column, has_video: Column) -> Column:
    """The declared rate, else bits over seconds if there is no video; else null: not measured."""
    return F.coalesce(declared, F.when(~has_video & (seconds > 0), 8.0 * size / seconds))


def dbfs(mean_square: Column) -> Column:
    """Level of a mean square in dB below full scale: minus infinity for digital silence, null for no data."""
    return F.when(mean_square > 0, 10 * F.log10(mean_square)).when(mean_square == 0, float("-inf"))


def psnr(mean_square_error: Column, peak: float) -> Column:
    return F.when(mean_square_error > 0, 10 * F.log10(peak * peak / mean_square_error)).when(mean_square_error == 0, float("inf"))
