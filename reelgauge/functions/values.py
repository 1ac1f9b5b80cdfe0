"""Casts, fallbacks, names and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTOCOLS = {"image": "image_only", "video": "video_only", "frame": "frame_only"}


def safe_double(x: Column) -> Column:
    """Null for what is no number, and for NaN."""
    number = x.try_cast("double")
    return F.when(~F.isnan(number), number)


def safe_int(x: Column) -> Column:
    return x.try_cast("int")


def first_truthy(*values: Column) -> Column:
    """First value that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def resolve_protocol(dtype: Column, protocol: Column) -> Column:
    named = F.lit(None).cast("string")
    for kind, name in PROTOCOLS.items():
        named = F.when(dtype == kind, name).otherwise(named)
    return F.coalesce(protocol, named, F.lit("combined_aux"))


def label_name(label: Column) -> Column:
    return F.when(label == 1, "real").otherwise("fake")


def paradigm(family: Column, model: Column) -> Column:
    words = F.lower(F.concat_ws(" ", family, model))
    return F.when(words.contains("convnext"), "CNN").when(words.rlike("vit|swin|maxvit|mvit|transformer"), "Transformer").otherwise("Other")


def sanitize(value: Column, fallback: str = "unknown") -> Column:
    """Runs of other characters become one underscore; outer marks go."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), "_+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def slug(*parts: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.concat_ws("_", *parts)), r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))


def display_label(protocol: Column, experiment: Column, family: Column, model: Column, loss: Column) -> Column:
    parts = F.array(experiment, family, model, F.when(protocol == "video", loss))
    return F.concat_ws(" | ", F.filter(parts, lambda p: p.isNotNull() & (p != "") & (p != "none")))


def format_metric(x: Column, digits: int = 4, missing: str = "na") -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)).otherwise(missing)


def duration(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where there is no whole."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def checkpoint_choice(preference: Column, has_best: Column, has_last: Column) -> Column:
    """The file asked for if it is there; auto: best, else last."""
    best, last = F.when(has_best, "best"), F.when(has_last, "last")
    return F.when(preference == "best", best).when(preference == "last", last).otherwise(F.coalesce(best, last))


def artifact_names(run: Column, acc: Column, f1: Column, suffix: str = ".pt") -> dict[str, Column]:
    tag = sanitize(run)
    scores = F.concat(F.lit("_acc-"), format_metric(acc), F.lit("_f1-"), format_metric(f1))
    return {
        "checkpoint_name": F.concat(F.lit("best_"), tag, scores, F.lit(suffix)),
        "summary_name": F.concat(F.lit("final_summary_"), tag, F.lit(".json")),
        "config_name": F.concat(F.lit("config_"), tag, F.lit(".json")),
        "archive_name": F.concat(tag, scores, F.lit(".zip")),
    }
