"""Raw match events to the events that are used, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SHOOTOUT
from tidemark.functions.scalar import parse_hms

BIG_XG = 0.3
WOODWORK = ("Post", "Saved to Post")
RAW = (
    "match string, index int, id string, type struct<name:string>, period int, timestamp string, minute int, second int, team struct<name:string>, player struct<name:string>, "
    "shot struct<statsbomb_xg:double,outcome:struct<name:string>,type:struct<name:string>>, foul_committed struct<penalty:boolean,card:struct<name:string>>, "
    "bad_behaviour struct<card:struct<name:string>>, pass struct<type:struct<name:string>>"
)


def big_chance(xg: Column, outcome: Column, least: float = BIG_XG) -> Column:
    """A shot that wasn't a goal, but likely one or off the woodwork."""
    return (outcome != "Goal") & ((xg >= least) | outcome.isin(*WOODWORK))


def normalize(raw: DataFrame) -> DataFrame:
    """match, seq, type, period, t, minute, second, team, player, sb_id, xg, outcome, shot_type, shootout, card, via of raw events
    (columns of RAW). One raw event gives none to two events; each period that started gets one start and one end. seq is the
    order of a match by period and time, nulls last, and then by index, the place in the raw list (null if there is none)."""
    name, p = F.col("type.name"), F.col("period")
    none = lambda t: F.lit(None).cast(t)

    def kind(k: str, when: Column, xg=None, outcome=None, shot_type=None, shootout=None, card=None, via=None) -> Column:
        of = [F.lit(k).alias("type"), (xg if xg is not None else none("double")).alias("xg"), (outcome if outcome is not None else none("string")).alias("outcome"), (shot_type if shot_type is not None else none("string")).alias("shot_type"), (shootout if shootout is not None else none("boolean")).alias("shootout"), (card if card is not None else none("string")).alias("card"), (F.lit(via) if via else none("string")).alias("via")]
        return F.when(when, F.struct(*of))

    xg, outcome, shot_type = F.round(F.coalesce(F.col("shot.statsbomb_xg"), F.lit(0.0)), 4), F.col("shot.outcome.name"), F.col("shot.type.name")
    foul, bad = F.col("foul_committed"), F.col("bad_behaviour.card.name")
    kinds = F.array(
        kind("shot", name == "Shot", xg, outcome, shot_type, p == SHOOTOUT),
        kind("goal", (name == "Shot") & (outcome == "Goal") & (p != SHOOTOUT), xg, shot_type=shot_type),
        kind("own_goal", name == "Own Goal For"),
        kind("penalty_foul", (name == "Foul Committed") & foul["penalty"]),
        kind("card", (name == "Foul Committed") & foul["card"].isNotNull(), card=foul["card"]["name"], via="foul"),
        kind("card", (name == "Bad Behaviour") & bad.isNotNull(), card=bad, via="bad_behaviour"),
        kind("corner", (name == "Pass") & (F.col("pass.type.name") == "Corner")),
        kind("substitution", name == "Substitution"),
        kind("offside", name == "Offside"),
    )
    base = ["match", "period", F.round(parse_hms(F.col("timestamp")), 3).alias("t"), "minute", "second", F.col("team.name").alias("team"), F.col("player.name").alias("player"), F.col("id").alias("sb_id")]
    place = F.col("index") if "index" in raw.columns else none("int").alias("index")
    used = raw.select(*base, place, F.posexplode(F.array_compact(kinds)).alias("_k", "k")).select("match", "period", "t", "minute", "second", "team", "player", "sb_id", "index", "_k", "k.*")
    ends = raw.where(name.isin("Half Start", "Half End")).groupBy("match", "period").agg(
        F.min(F.when(name == "Half Start", parse_hms(F.col("timestamp")))).alias("s"), F.max(F.when(name == "Half End", parse_hms(F.col("timestamp")))).alias("e")
    )
    ends = ends.where("s is not null").select("match", "period", F.explode(F.array(F.struct(F.lit("period_start").alias("type"), F.col("s").alias("t")), F.struct(F.lit("period_end").alias("type"), F.col("e").alias("t")))).alias("x"))
    every = used.unionByName(ends.select("match", "period", "x.type", "x.t"), allowMissingColumns=True)
    # of one time, events come as they were listed (by id, where nothing numbers them), and a period's ends after them
    listed = Window.partitionBy("match").orderBy("period", F.asc_nulls_last("t"), F.asc_nulls_last("index"), F.asc_nulls_last("sb_id"), F.asc_nulls_last("_k"), "type")
    return every.select("match", F.row_number().over(listed).alias("seq"), *[c for c in every.columns if c not in ("match", "index", "_k")])


def summarize(events: DataFrame) -> DataFrame:
    """Counts per match of normalized events, and minutes of each period that ended."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kind = lambda *k: F.col("type").isin(*k)
    shot = kind("shot") & ~F.coalesce(F.col("shootout"), F.lit(False))
    minutes = F.map_from_entries(F.array_sort(F.collect_list(F.when(kind("period_end") & (F.col("t") > 0), F.struct("period", F.round(F.col("t") / 60, 1).alias("m"))))))
    return events.groupBy("match").agg(
        n(kind("goal", "own_goal")).alias("goals"),
        n(kind("goal") & (F.col("shot_type") == "Penalty")).alias("pens_scored"),
        n(kind("card") & (F.col("card") == "Yellow Card")).alias("yellow"),
        n(kind("card") & (F.col("card") == "Second Yellow")).alias("second_yellow"),
        n(kind("card") & (F.col("card") == "Red Card")).alias("red"),
        n(kind("penalty_foul")).alias("penalty_fouls"),
        n(shot & big_chance(F.col("xg"), F.col("outcome"))).alias("big_chance_shots"),
        n(shot).alias("shots"),
        n(kind("corner")).alias("corners"),
        n(kind("substitution")).alias("subs"),
        minutes.alias("periods"),
    )
