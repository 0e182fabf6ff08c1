"""The frame tape: a ranking forward-filled and tweened into a dense per-frame leaderboard.

Nothing here builds an entity x period grid by a cross join. Every observed row knows how far it is carried
(until the entity's next row, or the carry cap), so it expands into its own run of periods, task by task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fixed
from ..functions import flag_emoji, leading_year, matched
from ..session import write_stage
from .entities import resolve_entities
from .ordering import first_per_group, with_neighbours
from .ranking import Ranking, best_first

def _by_entity():
    return Window.partitionBy("entity_id").orderBy("period_index")


def _count(first: int, last: int) -> Column:
    return F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))



def carried(rows: DataFrame, periods: int, max_carry: int | None = None) -> DataFrame:
    """(entity_id, value, seen, until): each value up to the entity's next row; past the last one, for at most ``max_carry`` periods."""
    last = F.lit(periods - 1).cast("bigint")
    trailing = last if max_carry is None else F.least(last, F.col("period_index") + max_carry)
    until = F.coalesce(F.lead("period_index").over(_by_entity()) - 1, trailing)
    return rows.select("entity_id", "value", F.col("period_index").alias("seen"), until.alias("until"))


def forward_fill(rows: DataFrame, periods: int, max_carry: int | None = None) -> DataFrame:
    """``carried`` values in every period. Nothing is filled before the first row. Filled rows have ``held = true``."""
    run = carried(rows, periods, max_carry)
    return run.select("entity_id", F.explode(F.sequence("seen", "until")).alias("period_index"), "value",
                      (F.col("period_index") > F.col("seen")).alias("held"))


def _nodes(periods: int) -> Column:
    """The nodes (level, number) of a binary tree over transitions that together are seen .. until - 1: two at most per level."""
    height = max(1, (periods - 1).bit_length())

    def at(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        first, end = F.ceil(F.col("seen") / width), F.floor(F.col("until") / width)
        left = F.when((first < end) & (first % 2 == 1), F.struct(level.alias("level"), first.cast("bigint").alias("node")))
        right = F.when((first < end) & (end % 2 == 1), F.struct(level.alias("level"), (end - 1).cast("bigint").alias("node")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height)), at)))


def drawable_fill(run: DataFrame, periods: int, top_n: int, direction: str) -> DataFrame:
    """``forward_fill`` of ``carried`` values, but for rows that cannot be drawn: top-N rows per period and the ends of each value, not all.

    While a value is carried its bar stands still. Each carried value is laid on at most two nodes per level of a tree over
    transitions. Where ``top_n`` values stand on a node, their last one is a line over its whole stretch: a value that is beyond it
    on the node or anywhere below is never among the top-N there, and is pruned before it is expanded. A value's
    first and last period always stay, since a bar moves there. ``drawable`` drops what seems to end where its rest was pruned: it
    stands still beyond the line, too.
    """
    still = run.filter(F.col("until") > F.col("seen")).withColumn("at", F.explode(_nodes(periods)))
    still = write_stage(still.select("entity_id", "value", "seen", F.col("at.level").alias("level"), F.col("at.node").alias("node")), "carried")
    lines = first_per_group(still.select("level", "node", "entity_id", "value"), ["level", "node"], best_first(direction), top_n, "_n")
    lines = lines.filter(F.col("_n") == top_n).select("level", "node", F.col("value").alias("line"))
    # At most two rows per period: a node's line is the strictest of its own and of those above it.
    height = max(1, (periods - 1).bit_length())
    up = F.explode(F.sequence(F.col("level"), F.lit(height))).alias("above")
    nodes = still.select("level", "node").distinct().select("level", "node", up)
    nodes = nodes.withColumn("higher", F.expr("shiftright(node, above - level)"))
    strictest = F.min if direction == "asc" else F.max
    above = lines.select(F.col("level").alias("above"), F.col("node").alias("higher"), "line")
    lines = write_stage(nodes.join(above, ["above", "higher"]).groupBy("level", "node").agg(strictest("line").alias("line")), "lines")
    slack = F.lit(1e-9) * (F.abs("line") + F.abs("value"))
    reaches = F.col("value") <= F.col("line") + slack if direction == "asc" else F.col("value") >= F.col("line") - slack
    left = still.join(lines, ["level", "node"], "left").filter(F.col("line").isNull() | reaches)
    first = F.call_function("shiftleft", F.col("node"), F.col("level"))
    end = F.call_function("shiftleft", F.col("node") + 1, F.col("level"))
    inner = left.select("entity_id", F.explode(F.sequence(first, end)).alias("period_index"), "value", "seen")
    ends = run.select("entity_id", F.explode(F.array_distinct(F.array("seen", "until"))).alias("period_index"), "value", "seen")
    rows = inner.unionByName(ends).dropDuplicates(["entity_id", "period_index"])
    return rows.select("entity_id", "period_index", "value", (F.col("period_index") > F.col("seen")).alias("held"))


def transitions(filled: DataFrame, periods: int, policy: str = "carryForward") -> DataFrame:
    """(transition, entity_id, a, b, held): the two ends between which an entity's bar moves.

    With one end missing, ``carryForward`` stands still on the other end and ``strict`` draws nothing.
    """
    nothing = F.lit(None)
    if periods == 1:
        return filled.select(F.lit(0).cast("bigint").alias("transition"), "entity_id", F.col("value").alias("a"),
                             F.col("value").alias("b"), "held")
    around = filled.withColumns({
        "next": F.lead(F.struct("period_index", "value", "held")).over(_by_entity()),
        "before": F.lag("period_index").over(_by_entity()),
    })
    joins_next = F.col("next.period_index") == F.col("period_index") + 1
    leaving = F.when(F.col("period_index") < periods - 1, F.struct(
        F.col("period_index").alias("transition"), F.col("value").alias("a"),
        F.when(joins_next, F.col("next.value")).alias("b"),
        F.when(joins_next, F.col("held") | F.col("next.held")).otherwise(F.lit(True)).alias("held")))
    starts = F.col("before").isNull() | (F.col("before") < F.col("period_index") - 1)
    entering = F.when(starts & (F.col("period_index") > 0), F.struct(
        (F.col("period_index") - 1).alias("transition"), nothing.cast("double").alias("a"), F.col("value").alias("b"),
        F.lit(True).alias("held")))
    ends = around.select("entity_id", F.inline(F.array_compact(F.array(leaving, entering))))
    if policy == "strict":
        return ends.dropna(subset=["a", "b"])
    return ends.withColumns({"a": F.coalesce("a", "b"), "b": F.coalesce("b", "a")})


def drawable(ends: DataFrame, top_n: int, direction: str) -> DataFrame:
    """Drop the entities that cannot be among the top-N at any moment of a transition.

    A bar stays between its two ends. If N entities stay on the better side of some line throughout, whoever
    never reaches that line is never drawn. The slack absorbs rounding of the in-between values.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    worst_end = high if direction == "asc" else low
    guard = ends.select("transition", "entity_id", worst_end.alias("line"))
    line = first_per_group(guard, ["transition"], best_first(direction, "line"), top_n, "_n")
    line = line.filter(F.col("_n") == top_n).select("transition", "line")
    slack = F.lit(1e-9) * (F.abs("line") + F.greatest(F.abs("a"), F.abs("b")))
    reaches = (low <= F.col("line") + slack) if direction == "asc" else (high >= F.col("line") - slack)
    return ends.join(line, "transition", "left").filter(F.col("line").isNull() | reaches).drop("line")


def carry_cap_in_periods(obs: DataFrame, years: int = 10) -> DataFrame:
    """One row: about ``years`` of carry, in periods, from the mean spacing of the distinct years."""
    found = obs.select(matched(F.col("date"), r"^(\d{1,4})", 1).cast("int").alias("y")).dropna().distinct()
    stats = found.agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("span"))
    span = F.when(F.col("n") > 1, F.col("span")).otherwise(1).cast("double")
    spacing = F.greatest(F.lit(1.0), span / F.greatest(F.lit(1), F.col("n") - 1))
    return stats.select(F.greatest(F.lit(1), F.floor(years / spacing + 0.5)).cast("bigint").alias("max_carry"))


@dataclass
class Tape:
    """A tape as flat tables: ``bars`` keyed by (frame_index, rank), frames, entity metadata, notes."""

    ranking: Ranking
    filled: DataFrame
    n_periods: int
    frames_per_transition: int
    policy: str

    @property
    def top_n(self) -> int:
        return self.ranking.top_n

    @property
    def n_transitions(self) -> int:
        return max(1, self.n_periods - 1)

    @property
    def last_moving_frame(self) -> int:
        return self.n_transitions * self.frames_per_transition - 1

    def order(self) -> list[Column]:
        return best_first(self.ranking.direction)

    def boundary_ranks(self) -> DataFrame:
        """Top-N of the filled series at each period."""
        return first_per_group(self.filled, ["period_index"], self.order(), self.top_n)

    def tweens(self, prune: bool = True, moments: str = "all") -> DataFrame:
        """Value of every entity that may be drawn, for the moving frames asked for.

        ``moments`` is all, boundaries (the first frame of each transition) or marks (these and the very last).
        """
        ends = transitions(self.filled, self.n_periods, self.policy)
        if prune:
            ends = drawable(ends, self.top_n, self.ranking.direction)
        steps = self.frames_per_transition
        frame = F.col("transition") * steps + F.col("k")
        wanted = _count(0, steps - 1) if moments == "all" else _count(0, 0)
        if moments == "marks":
            wanted = F.when(F.col("transition") == self.n_transitions - 1, F.array_distinct(F.concat(wanted, _count(steps - 1, steps - 1)))).otherwise(wanted)
        return (ends.withColumn("k", F.explode(wanted))
                .withColumn("t", F.col("k") / F.lit(float(steps)))
                .select(frame.alias("frame_index"), "transition", "k", "t", "entity_id",
                        (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("value"), "held"))

    def drawn(self, prune: bool = True, moments: str = "all") -> DataFrame:
        """The top-N of each moving frame."""
        return first_per_group(self.tweens(prune, moments), ["frame_index"], self.order(), self.top_n)

    def bars(self, prune: bool = True, hold: bool = True, moments: str = "all", exact_final: bool = False) -> DataFrame:
        """Drawn bars. The last moving frame is repeated for one more transition when ``hold``.

        With ``exact_final`` the hold shows the last period's own values.
        """
        if hold and exact_final:
            return self.bars(prune, False, moments).unionByName(self.exact_final_bars())
        drawn = self.drawn(prune, moments)
        in_frame = Window.partitionBy("frame_index")  # at most top_n rows each
        scale = F.greatest(F.max("value").over(in_frame), F.lit(fixed.SMALLEST_BAR_SCALE))
        drawn = drawn.withColumn("max_value", scale)
        before = self.boundary_ranks().select(F.col("period_index").alias("transition"), "entity_id",
                                              F.col("rank").alias("previous_rank"))
        bars = drawn.join(before, ["transition", "entity_id"], "left")
        bars = bars.withColumns({
            "width": F.col("value") / F.col("max_value"),
            "rank_delta": F.col("previous_rank") - F.col("rank"),
            "is_boundary": F.col("k") == 0,
        }).withColumn("is_mover", F.coalesce(F.abs("rank_delta") >= self.ranking.mover_threshold, F.lit(False)))
        if hold:
            last = self.last_moving_frame
            repeats = F.when(F.col("frame_index") == last, _count(last, last + self.frames_per_transition))
            bars = bars.withColumn("shown", F.explode(F.coalesce(repeats, F.array("frame_index"))))
            bars = bars.withColumn("frame_index", F.col("shown")).drop("shown")
        return bars.select("frame_index", "transition", "entity_id", "value", "rank", "previous_rank", "width", "held",
                           "rank_delta", "is_mover", "is_boundary", "max_value")

    def exact_final_bars(self) -> DataFrame:
        """The hold as the last period itself, instead of the last moving frame: bars of the filled series there."""
        ranks, n, steps = self.boundary_ranks(), self.n_periods, self.frames_per_transition
        before = ranks.filter(F.col("period_index") == max(n - 2, 0)).select("entity_id", F.col("rank").alias("previous_rank"))
        scale = F.greatest(F.max("value").over(Window.partitionBy("period_index")), F.lit(fixed.SMALLEST_BAR_SCALE))  # top_n rows
        end = ranks.filter(F.col("period_index") == n - 1).withColumn("max_value", scale).join(before, "entity_id", "left")
        change = F.col("previous_rank") - F.col("rank")
        first = self.last_moving_frame + 1
        return end.select(
            F.explode(_count(first, first + steps - 1)).alias("frame_index"), F.lit(self.n_transitions - 1).cast("bigint").alias("transition"),
            "entity_id", "value", "rank", "previous_rank", (F.col("value") / F.col("max_value")).alias("width"), "held",
            change.alias("rank_delta"), F.coalesce(F.abs(change) >= self.ranking.mover_threshold, F.lit(False)).alias("is_mover"),
            F.lit(False).alias("is_boundary"), "max_value")

    def frames(self) -> DataFrame:
        """One row per frame: labels, position in the transition, boundary flag, bar scale."""
        steps, n = self.frames_per_transition, self.n_periods
        labels = self.ranking.periods().select("period_index", "label")
        following = F.coalesce(F.lead("label").over(Window.orderBy("period_index")), F.col("label"))
        pairs = labels.withColumn("to_label", following).filter(F.col("period_index") < self.n_transitions)
        moving = pairs.withColumn("k", F.explode(_count(0, steps - 1)))
        moving = moving.withColumn("t", F.col("k") / F.lit(float(steps))).select(
            (F.col("period_index") * steps + F.col("k")).alias("frame_index"),
            F.when(F.col("t") < 0.5, F.col("label")).otherwise(F.col("to_label")).alias("label"),
            F.col("label").alias("from_label"), "to_label", "t", (F.col("k") == 0).alias("is_period_boundary"))
        end = self.last_moving_frame
        held = labels.filter(F.col("period_index") == n - 1).withColumn("frame_index", F.explode(_count(end + 1, end + steps)))
        held = held.select("frame_index", "label", F.col("label").alias("from_label"), F.col("label").alias("to_label"),
                           F.lit(1.0).alias("t"), F.lit(False).alias("is_period_boundary"))
        scale = self.drawn().groupBy("frame_index").agg(F.greatest(F.max("value"), F.lit(fixed.SMALLEST_BAR_SCALE)).alias("max_value"))
        shown = F.when(F.col("frame_index") == end, _count(end, end + steps)).otherwise(F.array("frame_index"))  # the last one is held
        scale = scale.select(F.explode(shown).alias("frame_index"), "max_value")
        every = moving.unionByName(held).join(scale, "frame_index", "left")
        return every.withColumn("max_value", F.coalesce("max_value", F.lit(fixed.SMALLEST_BAR_SCALE)))

    def entity_meta(self, explicit: DataFrame | None = None, dictionary: DataFrame | None = None) -> DataFrame:
        """Drawn entities, most prominent first: name, colour, flag, group; ``explicit`` overrides by entity_id.

        Its rows are the entities that reach the top-N, so at most top_n per period.
        """
        place = F.row_number().over(Window.orderBy(*best_first(self.ranking.direction, "total"))).cast("bigint") - 1
        order = self.ranking.entity_order().withColumn("place", place)
        named = order.join(self.ranking.names(), "entity_id")
        known = resolve_entities(named.withColumn("lookup", F.col("entity_id")), "lookup", dictionary)
        palette = F.array(*[F.lit(c) for c in fixed.PALETTE])
        colour = F.element_at(palette, (F.col("place") % len(fixed.PALETTE) + 1).cast("int"))
        found = F.col("resolution") == "resolved"
        meta = known.select("entity_id", "entity", "place", colour.alias("color"),
                            F.when(found, flag_emoji("iso2")).alias("flag"),
                            F.when(found, F.col("flag_code")).alias("flag_code"),
                            F.when(found, F.col("region")).alias("group"))
        if explicit is None:
            return meta.withColumns({"logo": F.lit(None).cast("string"), "image": F.lit(None).cast("string")})
        given = explicit.select("entity_id", *[F.col(c).alias("_" + c) for c in ("name", "color", "logo", "image", "group")])
        both = meta.join(given, "entity_id", "left")
        return both.select("entity_id", F.coalesce("_name", "entity").alias("entity"), "place",
                           F.coalesce("_color", "color").alias("color"), "flag", "flag_code",
                           F.coalesce("_group", "group").alias("group"), F.col("_logo").alias("logo"),
                           F.col("_image").alias("image"))

    def notes(self) -> DataFrame:
        """Counts behind the notes: held bar-frames (the final hold not counted) and what ranking dropped."""
        held = self.drawn().agg(F.count(F.when(F.col("held"), F.lit(1)))).scalar()
        return self.ranking.counters().select(held.alias("held_bar_frames"), "*")


def build_tape(ranking: Ranking, frames_per_transition: int = 30, policy: str = "carryForward",
               max_carry: int | None = None, fill_from: str = "topn") -> Tape:
    """Fill and tween a ranking that has a ``top_n``.

    ``fill_from="topn"`` carries only values that were drawn, so an entity that leaves the top-N keeps its last
    drawn value. ``fill_from="all"`` uses every observed cell; ``filled`` then holds the rows that may be drawn and the ends of
    every carried value, as entities times periods would be too many.
    """
    if policy not in ("carryForward", "strict"):
        raise ValueError(f"unknown policy {policy!r}")
    if ranking.top_n is None:
        raise ValueError("a tape needs a ranking with top_n")
    cells = ranking.top if fill_from == "topn" else ranking.plain.filter("n_valued > 0")
    periods = ranking.periods()
    seen = cells.join(periods.select("sort_key", "period_index"), "sort_key")
    n_periods = periods.count()
    seen = seen.select("entity_id", "period_index", "value")
    if fill_from == "topn":
        filled = forward_fill(seen, n_periods, max_carry)
    else:
        run = write_stage(carried(seen, n_periods, max_carry), "runs")
        filled = drawable_fill(run, n_periods, ranking.top_n, ranking.direction)
    return Tape(ranking, write_stage(filled, "filled"), n_periods, frames_per_transition, policy)


def tape_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found in one tape only, with the side they came from; empty when the two agree."""
    columns = sorted(set(left.columns) & set(right.columns))
    a, b = left.select(*columns), right.select(*columns)
    return (a.exceptAll(b).withColumn("side", F.lit("left"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("right"))))


def interpolate_at(points: DataFrame, moments: DataFrame) -> DataFrame:
    """Piecewise-linear value of each irregular series at each moment.

    ``points(entity_id, x, value)`` and ``moments(entity_id, x)`` are laid on one axis per entity, once for both
    directions, so each moment knows the points around it. It takes the line between them, 0 before the first
    point and the last value after the last one. A series may be of any length: see ``with_neighbours``.
    """
    axis = (points.select("entity_id", "x", F.struct("x", "value").alias("point"), F.lit(0).alias("is_moment"))
            .unionByName(moments.select("entity_id", "x", F.lit(1).alias("is_moment")), allowMissingColumns=True))
    around = with_neighbours(axis, ["entity_id"], [F.col("x"), F.col("is_moment")], F.col("point"), "l", "r", name="axis").filter("is_moment = 1")
    share = (F.col("x") - F.col("l.x")) / (F.col("r.x") - F.col("l.x"))
    value = (F.when(F.col("l").isNull(), F.lit(0.0))
             .when(F.col("r").isNull() | (F.col("x") == F.col("l.x")), F.col("l.value"))
             .otherwise(F.col("l.value") + (F.col("r.value") - F.col("l.value")) * share))
    return around.select("entity_id", "x", value.alias("value"))


def logistic_spread(totals: DataFrame, until: int) -> DataFrame:
    """Lifetime totals (entity_id, launch, finish, total) to yearly cumulative values on an adoption curve.

    The curve is steepest at 35 % of the lifetime and reaches the total at ``finish``.
    """
    def s(x: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-10.0) * (x - F.lit(0.35))))

    years = totals.filter(F.col("launch") <= until).withColumn("year", F.explode(F.sequence(F.col("launch"), F.lit(until))))
    life = (F.col("year") - F.col("launch")) / F.greatest(F.lit(1), F.col("finish") - F.col("launch"))
    grown = (s(life) - s(F.lit(0.0))) / (s(F.lit(1.0)) - s(F.lit(0.0)))
    value = F.when(F.col("year") >= F.col("finish"), F.col("total")).otherwise(F.round(F.col("total") * grown, 2))
    return years.select("entity_id", "year", value.alias("value")).filter("value > 0")


def sparse_head(obs: DataFrame, top_n: int) -> DataFrame:
    """One row: the first year kept (null when nothing is trimmed), the first year there is, and how many periods go.

    A year is full when as many entities report as the chart shows, or all there are. The (year, entity) pairs are
    written once and decide everything.
    """
    year = leading_year("date")
    usable = obs.filter(~F.coalesce("status", F.lit("")).isin("CONFLICTING", "REJECTED") & F.col("value").isNotNull()
                        & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))
    pairs = write_stage(usable.select(year.alias("y"), "entity_id").dropna(subset=["y"]).distinct(), "reporting-years")
    # Entities and years are counted apart, so that neither count sees the other's groups.
    entities = pairs.groupBy("entity_id").count().agg(F.count("*").alias("entities"))
    years = pairs.groupBy("y").agg(F.count("*").alias("n"))
    wanted = F.greatest(F.lit(2), F.least(F.lit(top_n), F.col("entities")))
    marked = years.withColumn("full", F.col("n") >= entities.select(wanted).scalar())
    first = marked.agg(F.min(F.when(F.col("full"), F.col("y"))).alias("full"), F.min("y").alias("first_year"),
                       F.sort_array(F.collect_list("y")).alias("years"))  # one number per year
    trims = F.col("full") > F.col("first_year")
    return first.select(F.when(trims, F.col("full")).alias("kept_from"), "first_year",
                        F.when(trims, F.size(F.filter("years", lambda y: y < F.col("full")))).otherwise(F.lit(0)).alias("dropped_periods"))


def trim_sparse_head(obs: DataFrame, top_n: int, head: DataFrame | None = None) -> DataFrame:
    """Drop the periods before the first year in which enough entities report to fill the chart.

    No year qualifies, or the first one does: everything is kept. ``head`` is the ``sparse_head`` to go by, if it is at hand.
    """
    head = write_stage(sparse_head(obs, top_n), "sparse-head") if head is None else head
    # Without a cut the threshold lies below every year, and below the stand-in for a date without a year.
    start = head.select(F.coalesce("kept_from", F.lit(-100_002))).scalar()
    return obs.filter(F.coalesce(leading_year("date"), F.lit(-100_001)) >= start)
