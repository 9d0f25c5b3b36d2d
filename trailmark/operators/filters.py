"""Predicates of the log views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours of each time range; an unknown range means all (ten years).
HOURS = {"1h": 1, "6h": 6, "1d": 24, "7d": 168}
ALL_HOURS = 87_600


def clock(rows: DataFrame) -> Column:
    """The newest timestamp as a scalar subquery: Spark runs it once, and pushes the comparison to the scan."""
    return rows.agg(F.max("timestamp")).scalar()


def since(now: Column, time_range: str) -> Column:
    return F.col("timestamp") >= now - F.expr(f"INTERVAL {HOURS.get(time_range, ALL_HOURS)} HOURS")


def of_backend(backend: str) -> Column:
    return F.lit(True) if backend == "all" else F.col("backend") == backend


def of_model(model: str) -> Column:
    return F.lit(True) if model == "all" else F.coalesce("model", F.lit("unknown")) == model


def of_action(action: str) -> Column:
    wanted = {"passed": 0, "redacted": 1, "blocked": 2}
    return F.coalesce("dlp_action", F.lit(0)) == wanted[action] if action in wanted else F.lit(True)


def of_view(view: str) -> Column:
    return {"token_saving": F.col("tokens_saved") > 0, "guardian": F.col("dlp_action") > 0}.get(view, F.lit(True))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mentions(text: str) -> Column:
    """The text, as it is, anywhere in request or response; only ASCII letters match regardless of case."""
    if not text:
        return F.lit(True)
    wanted = _ascii_lower(F.lit(text))
    return F.coalesce(_ascii_lower(F.col("request_body")).contains(wanted), F.lit(False)) | F.coalesce(_ascii_lower(F.col("response_body")).contains(wanted), F.lit(False))


def prompts() -> Column:
    return F.col("endpoint_name").ilike("%prompt%")


def tools() -> Column:
    return F.col("endpoint_name").ilike("%tool%")


#: Paths of generated and lock files, matched regardless of case.
GENERATED = (
    r"\.lock$",
    r"lock\.json$",
    r"package-lock\.json$",
    r"yarn\.lock$",
    r"pnpm-lock\.yaml$",
    r"Cargo\.lock$",
    r"Gemfile\.lock$",
    r"composer\.lock$",
    r"poetry\.lock$",
    r"Pipfile\.lock$",
    r"\.sum$",
    r"\.min\.js$",
    r"\.min\.css$",
    r"\.bundle\.js$",
    r"\.map$",
    r"\.generated\.",
    r"\.pb\.go$",
    r"\.g\.dart$",
    r"/dist/",
    r"/build/",
    r"/node_modules/",
    r"/vendor/",
)


def generated(path: Column) -> Column:
    return path.rlike("(?i)" + "|".join(f"(?:{p})" for p in GENERATED))
