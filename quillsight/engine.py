"""The engine as one object: settings with checks, and detection over mixed tables of text, images, audio and video."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .functions import lexicon, routing
from .operators import audio, image, text_signals, verdicts, video

ENVIRONMENTS = ("development", "staging", "production")
LEAST_UPLOAD, MOST_UPLOAD = 1024, 1024**3
#: The settings that name an external scorer's key.
KEYS = ("HIVE_API_KEY", "OPENAI_API_KEY", "GPTZERO_API_KEY")


def _whole(value: str | None, default: int) -> int:
    """A whole number, or the default for anything else."""
    try:
        return int(value) if value else default
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    """What a run is set up with. Which external scorers are in use only tells whether their scores are expected; nothing is called."""

    environment: str = "development"
    port: int = 8080
    store: str = ""
    scorers: tuple[str, ...] = ()
    max_upload_bytes: int = 100 * 1024 * 1024
    requests_per_minute: int = 60
    origins: tuple[str, ...] = ("*",)
    key_required: bool = False

    @staticmethod
    def load(env: Mapping[str, str] | None = None) -> Settings:
        """From environment variables; what is missing or can't be read has its default. Production needs explicit origins and keys."""
        env = os.environ if env is None else env
        name = env.get("ENV") or "development"
        origins = tuple(o.strip() for o in (env.get("ALLOWED_ORIGINS") or "*").split(","))
        needed = (env.get("API_KEY_REQUIRED") or "").lower() in ("1", "t", "true")
        production = name == "production"
        return Settings(
            name, _whole(env.get("PORT"), 8080), env.get("DATABASE_URL", ""), tuple(k for k in KEYS if env.get(k)), _whole(env.get("MAX_UPLOAD_SIZE"), 100 * 1024 * 1024),
            _whole(env.get("RATE_LIMIT_PER_MINUTE"), 60), () if production and origins[0] == "*" else origins, production or needed,
        )

    def problems(self) -> list[str]:
        """Everything that is wrong, in order; nothing if the settings can be used."""
        production = self.environment == "production"
        checks = (
            (not 1 <= self.port <= 65535, f"invalid port: {self.port}"),
            (self.environment not in ENVIRONMENTS, f"invalid environment: {self.environment}"),
            (production and not self.store, "a store is required in production"),
            (production and not self.origins, "origins must be set in production"),
            (production and not self.scorers, "at least one scorer's key is required in production"),
            (self.max_upload_bytes < LEAST_UPLOAD, f"upload size too small: {self.max_upload_bytes}"),
            (self.max_upload_bytes > MOST_UPLOAD, f"upload size too large: {self.max_upload_bytes}"),
        )
        return [said for wrong, said in checks if wrong]

    def validate(self) -> Settings:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


def request_id(given: Column | None = None) -> Column:
    """16 hex digits that follow a row through a job: the given ones, or new ones (random, so write them before they are used twice)."""
    new = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)
    return new if given is None else F.when(F.coalesce(given != "", F.lit(False)), given).otherwise(new)


class Detector:
    """Detects what machines made in tables of items, whatever their kind."""

    def __init__(self, settings: Settings = Settings(), preset: str = "balanced"):  # noqa: B008
        self.settings, self.preset = settings.validate(), preset

    def detect(self, items: DataFrame, key: str, external: DataFrame | None = None) -> DataFrame:
        """One row for each row of items: key, request_id, content_type, human, confidence, ai_score, detectors, content_hash, error.

        items: key, and any of url, text, data, filename, content_type, request_id. A content type that is missing or unknown is found from
        text, file name, URL and bytes, in this order; each kind is a plan of its own over its rows. external: scores of other detectors (key, detector, score),
        joined in by their weights. Items that can't be used have an error and no verdict: no content, invalid URLs, texts and files out of bounds, unknown types,
        bytes that can't be read, and items given by URL only, as nothing is fetched. Repeated keys give a row each, unless external scores are given, which go by key.
        """
        given = lambda name, kind: (F.col(name) if name in items.columns else F.lit(None)).cast(kind).alias(name)
        rows = items.select(F.col(key), given("url", "string"), given("text", "string"), given("data", "binary"), given("filename", "string"), given("content_type", "string"), request_id(given("request_id", "string")).alias("request_id"))
        known = F.col("content_type").isin(*routing.EXTENSIONS)
        kind = F.when(F.coalesce(known, F.lit(False)), F.col("content_type")).otherwise(routing.content_type(F.col("text"), F.col("filename"), F.col("url"), F.col("data")))
        rows = rows.withColumn("content_type", kind).withColumn("content_hash", routing.content_hash(F.col("text"), F.col("data"), F.col("url")))
        present = F.coalesce(F.octet_length(F.when(F.col("content_type") == "text", F.col("text").cast("binary")).otherwise(F.col("data"))) > 0, F.lit(False))
        problem = F.coalesce(
            routing.validation_error(F.col("text"), F.col("url"), F.col("data"), self.settings.max_upload_bytes),
            F.when(F.col("content_type") == "unknown", "unsupported content type: unknown"), F.when(~present, "not fetched"),
        )
        rows = rows.withColumn("error", problem)
        out = rows.where("error IS NOT NULL").select(key, "request_id", "content_type", "content_hash", F.lit(None).cast("double").alias("ai_score"), "error")
        for part in self._scored(rows.where("error IS NULL"), key):
            out = out.unionByName(part)
        if external is None:
            out = out.withColumn("detectors", F.when(F.col("ai_score").isNotNull(), F.array(F.lit("local"))))
        else:
            out = self._with_external(out, key, external)
        return verdicts.add_verdict(out).select(key, "request_id", "content_type", "human", "confidence", "ai_score", "detectors", "content_hash", "error")

    def _scored(self, rows: DataFrame, key: str) -> Sequence[DataFrame]:
        of = lambda kind, *more: rows.where(F.col("content_type") == kind).select(key, "request_id", "content_type", "content_hash", *more)
        signals = text_signals.read_texts(of("text", "text"), lexicon.SIGNALS, keep=[key, "request_id", "content_type", "content_hash"])
        score = text_signals.weighted_score([F.col(n) for n in lexicon.SIGNALS], lexicon.preset_weights(self.preset))
        parts = [signals.select(key, "request_id", "content_type", "content_hash", score.alias("ai_score"), F.lit(None).cast("string").alias("error"))]
        for kind, analyse in (("image", image.analyze_images), ("audio", audio.analyze_audios), ("video", video.analyze_videos)):
            found = analyse(of(kind, "data"), "data")
            parts.append(found.select(key, "request_id", "content_type", "content_hash", F.col(kind).ai_score.alias("ai_score"), F.col(kind).error.alias("error")))
        return parts

    @staticmethod
    def _with_external(found: DataFrame, key: str, external: DataFrame) -> DataFrame:
        """ai_score and detectors from all scores of an item; an item without a local score has none."""
        kinds = found.where("ai_score IS NOT NULL").select(key, "content_type", F.lit("local").alias("detector"), F.col("ai_score").alias("score"))
        others = external.select(key, "detector", F.col("score").cast("double").alias("score")).join(kinds.select(key, "content_type").distinct(), key)
        means = verdicts.aggregate_detectors(kinds.unionByName(others), [key, "content_type"], F.col("content_type")).withColumnRenamed("content_type", "of_type")
        means = means.withColumnsRenamed({key: "of_key"})
        joined = found.drop("ai_score").join(means, (F.col(key) == F.col("of_key")) & (F.col("content_type") == F.col("of_type")) & F.col("error").isNull(), "left")
        return joined.drop("of_key", "of_type")
