"""Audio quality as column expressions over codec, lossless, bit depth, sample rate and bitrate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegraph.functions.text import format_rate


def is_hi_res(lossless: Column, rate: Column, depth: Column) -> Column:
    return F.coalesce(lossless, F.lit(False)) & ((F.coalesce(rate, F.lit(0)) > 48000) | (F.coalesce(depth, F.lit(0)) > 16))


def quality_label(codec: Column, lossless: Column, depth: Column, rate: Column, kbps: Column) -> Column:
    """``FLAC 16/44.1``, ``MP3 320 kbps`` or the codec alone."""
    name = F.upper(codec)
    full = F.concat(name, F.lit(" "), depth.cast("string"), F.lit("/"), F.replace(format_rate(rate), F.lit(" kHz"), F.lit("")))
    return F.when(F.coalesce(lossless, F.lit(False)) & depth.isNotNull() & rate.isNotNull(), full).when(kbps.isNotNull(), F.concat(name, F.lit(" "), kbps.cast("string"), F.lit(" kbps"))).otherwise(name)


def quality_tier(codec: Column, lossless: Column, depth: Column, rate: Column, kbps: Column) -> Column:
    lossy = F.when(kbps >= 256, "high").when(kbps < 256, "low").otherwise("unknown")
    return F.when(codec == "", "unknown").when(lossless, F.when(is_hi_res(lossless, rate, depth), "hi-res").otherwise("lossless")).otherwise(lossy)
