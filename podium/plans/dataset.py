"""From several raw tables to one verified dataset, its report and its tape."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import ascii_slug, infer_frequency
from ..operators import clean, entities, insight, quality, ranking, shape, tape, verify
from ..session import write_stage

_PER_SOURCE = Decimal(1 << 64)  # more than any bigint, so the keys of two sources never meet


@dataclass
class SourceTable:
    """A raw table of strings and where it comes from. An ``ord`` column, if any, gives the row order."""

    table: DataFrame
    publisher: str
    url: str
    unit: str = "count"
    confidence: float | None = None


@dataclass
class Dataset:
    observations: DataFrame
    verification: verify.Verification
    dropped: DataFrame
    max_date: str
    options: dict = field(default_factory=dict)

    def stats(self) -> DataFrame:
        return insight.dataset_stats(self.observations)

    def unit(self) -> DataFrame:
        return insight.majority_unit(self.observations)

    def time_range(self) -> DataFrame:
        return insight.observed_range(self.observations)

    def report(self) -> DataFrame:
        """All core checks, the ranking that the tape is made of included."""
        ranked = self.ranking(top_n=None).cells.filter("n_valued > 0")
        return quality.quality_report(quality.core_counts(self.observations, self.max_date, ranked=ranked), quality.CORE_CHECKS)

    def ranking(self, top_n: int | None = 10, **options) -> ranking.Ranking:
        return ranking.rank_observations(clean.tape_input(self.observations)[0], top_n, **options)

    def tape(self, top_n: int = 10, frames_per_transition: int = 30, direction: str = "desc", max_carry: int | None = None) -> tape.Tape:
        """Tape of the undisputed rows; trailing values are carried for about ten years unless ``max_carry`` says otherwise."""
        if max_carry is None:
            max_carry = tape.carry_cap_in_periods(self.observations).first()["max_carry"]
        return tape.build_tape(self.ranking(top_n, direction=direction), frames_per_transition, max_carry=max_carry)


def source_observations(sources: list[SourceTable], countries_only: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """Drafts of every table as observations, entity names brought to one spelling, appended in source order."""
    parts = []
    for i, source in enumerate(sources):
        drafts = shape.drafts_from_table(source.table, source.unit)
        place = F.col("ord").cast("bigint") if "ord" in drafts.columns else F.monotonically_increasing_id()
        drafts = drafts.withColumn("ord", place.cast("decimal(38,0)") + F.lit(i * _PER_SOURCE).cast("decimal(38,0)"))
        named = (entities.countries_only if countries_only else entities.canonical_names)(drafts, "entity", dictionary)
        parts.append(named.select("ord", "entity", "date", "value", "unit").withColumns(
            {"source": F.lit(source.publisher), "source_url": F.lit(source.url), "confidence": F.lit(source.confidence).cast("double")}))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumns({
        "entity_id": ascii_slug("entity"), "frequency": infer_frequency("date"),
        "status": F.when(F.col("value").isNull(), F.lit("UNKNOWN")).otherwise(F.lit("SUPPORTED"))})


def build_dataset(sources: list[SourceTable], max_date: str, top_n: int = 10, tolerance: float = 0.05, countries_only: bool = False,
                  keep: list[str] | None = None, dictionary: DataFrame | None = None) -> Dataset:
    """Clean, verify against each other, keep the primary source's series, and cut a sparse head.

    The appended observations are written once: verification reads them several times, and their order is pinned.
    """
    rows = write_stage(source_observations(sources, countries_only, dictionary), "observations")
    if keep:
        rows = entities.keep_entities(rows, keep)
    kept, dropped = clean.sanitize(rows)
    verified = verify.verify_across_sources(kept, tolerance, single_source=True)
    final = write_stage(tape.trim_sparse_head(verified.observations, top_n), "dataset")
    return Dataset(final, verified, dropped, max_date)
