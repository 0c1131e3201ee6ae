"""Interval, as-of and range joins with an equality key, so that none becomes a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000


def match_events(flows: DataFrame, events: DataFrame, reverse: bool = True) -> DataFrame:
    """``flow_id, status, event_ids, rule, agrees``: the events whose time and endpoints a flow meets.

    Events are found under each UTC day they touch, flows under the day they start. A null event port is a wildcard. One event is a unique match, several are ambiguous. Equal endpoints match in reverse as well.
    """
    days = F.explode(F.sequence(F.floor(F.col("start_ms") / DAY), F.floor(F.col("end_ms") / DAY)))
    direct = events.select("event_id", F.col("start_ms").alias("e_start"), F.col("end_ms").alias("e_end"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dport").alias("e_dport"), F.col("label").alias("e_label"), days.alias("day"), F.lit(0).alias("back"))
    if reverse:
        direct = direct.union(direct.select("event_id", "e_start", "e_end", F.col("b").alias("a"), F.col("a").alias("b"), "e_dport", "e_label", "day", F.lit(1).alias("back")))
    left = flows.withColumn("day", F.floor(F.col("start_ms") / DAY))
    on = (left.day == direct.day) & (left.src == direct.a) & (left.dst == direct.b) & (direct.e_start <= left.end_ms) & (direct.e_end >= left.start_ms) & (direct.e_dport.isNull() | (direct.e_dport == left.dport))
    rule = F.when(direct.back == 1, "reverse_direction_time").when(direct.e_dport.isNull(), "wildcard_port_time").otherwise("exact_tuple_time")
    hits = left.join(direct, on).groupBy("flow_id", "event_id").agg(F.max(rule).alias("rule"), F.max("e_label").alias("e_label"), F.first(left.label).alias("label"))
    found = hits.groupBy("flow_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("event_ids"), F.min("rule").alias("rule"), F.bool_and(F.col("label") == F.col("e_label")).alias("agrees"))
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return flows.select("flow_id").join(found, "flow_id", "left").select("flow_id", status.alias("status"), "event_ids", F.when(F.col("n") == 1, F.col("rule")).alias("rule"), F.when(F.col("n") == 1, F.col("agrees")).alias("agrees"))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], low: Column, high: Column, time: str, cap: Column | None = None, tie: str = "", row: str = "") -> DataFrame:
    """Rows of ``right`` of the same key whose ``time`` lies in ``[low, high]`` of a left row, the first ``cap`` of each."""
    out = left.withColumns({"_lo": low, "_hi": high}).join(right, keys).where(F.col(time).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    if cap is None:
        return out
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(row).orderBy(time, tie))).where(F.col("_r") <= cap).drop("_r")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, valid_from: str, columns: list[str], tie: str) -> DataFrame:
    """Each left row with the right row of its key of the latest ``valid_from`` up to ``at``, by one sort of both sides."""
    packed = F.struct(F.col(valid_from).alias("_from"), *columns)
    a = left.select("*", F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_tie"))
    b = right.select(*keys, F.col(valid_from).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).cast("long").alias("_tie"), packed.alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_row", True).over(w)).where("_kind = 1")
    return both.select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in columns], F.col("_last._from").alias(f"from_{valid_from}"))


def overlay(source: DataFrame, revision: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``source`` with the columns that ``revision`` sets."""
    new = revision.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return source.join(new, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in source.columns])


def match_five_tuples(flows: DataFrame, events: DataFrame) -> DataFrame:
    """``flow_id, events, first_event, rule`` of the flows that meet an event in time, addresses, ports and protocol, either way.

    Ports and protocol of an event that are null fit any. Only addresses and the day are joined on, so wildcards cause no
    nested loop; a flow is found under the day it starts, an event under each day that it touches.
    """
    days = F.explode(F.sequence(F.floor(F.col("a") / DAY), F.floor(F.col("b") / DAY)))
    side = lambda s, t, sp, dp, back: events.select("event_id", F.col("a").alias("e_a"), F.col("b").alias("e_b"), F.col(s).alias("s"), F.col(t).alias("t"), F.col(sp).alias("sp"), F.col(dp).alias("dp"), F.col("proto").alias("e_proto"), F.lit(back).alias("back"), days.alias("day"))
    both = side("src", "dst", "sport", "dport", 0).union(side("dst", "src", "dport", "sport", 1))
    f = flows.withColumn("day", F.floor(F.col("start_ms") / DAY))
    fits = lambda a, b: F.col(a).isNull() | (F.col(a) == F.col(b))
    on = (f.day == both.day) & (F.col("src") == F.col("s")) & (F.col("dst") == F.col("t")) & (F.col("e_a") <= F.col("end_ms")) & (F.col("e_b") >= F.col("start_ms"))
    on = on & fits("e_proto", "proto") & fits("sp", "sport") & fits("dp", "dport")
    exact = F.col("sp").isNotNull() & F.col("dp").isNotNull()
    hits = f.join(both, on).groupBy("flow_id", "event_id").agg(F.min("back").alias("back"), F.bool_and(exact).alias("exact"))
    rule = F.when(F.count("*") > 1, "ambiguous").when(F.min("back") == 1, "reverse_direction_time").when(F.bool_and("exact"), "exact_5tuple_time").otherwise("wildcard_port_time")
    return hits.groupBy("flow_id").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), rule.alias("rule"))


def relation_cascade(relations: DataFrame, flows: DataFrame, width: int) -> DataFrame:
    """For each relation ``id`` of ``scope, [a, b]`` how many flows of its scope and time fit, by which rule, which way, or why none.

    Endpoints ``x, y`` and ports ``px, py`` of a relation that are null fit any. Rules: R0 all equal, R1 all equal in reverse,
    R2 endpoints and ports, R3 with an open endpoint, R4 with an open port, R5 none. Flows are found by scope and bucket of
    time, of ``width``; relations without a flow in time stay.
    """
    span = F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))).alias("bucket")
    r = relations.select("*", span)
    f = flows.withColumn("bucket", F.floor(F.col("start_ms") / width))
    met = r.join(f, ["scope", "bucket"]).where(F.col("start_ms").between(F.col("a"), F.col("b")))
    eq = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    fits = lambda a, b: F.col(a).isNull() | (F.col(a) == F.col(b))
    direct, back = eq("x", "s") & eq("y", "t") & eq("px", "ps") & eq("py", "pt"), eq("x", "t") & eq("y", "s") & eq("px", "pt") & eq("py", "ps")
    one, other = fits("x", "s") & eq("y", "t"), fits("x", "t") & eq("y", "s")
    one_p, other_p = one & fits("px", "ps") & fits("py", "pt"), other & fits("px", "pt") & fits("py", "ps")
    count = {"in_time": F.lit(True), "direct": direct, "back": back, "ends": one | other, "fits": one_p | other_p, "d": one_p, "r": other_p}
    g = met.groupBy("id").agg(*[F.count_if(c).alias(n) for n, c in count.items()])
    out = relations.select("id", F.col("x").isNull().alias("wild"), (F.col("px").isNull() | F.col("py").isNull()).alias("open")).join(g, "id", "left").na.fill(0, list(count))
    some = lambda c: F.col(c) > 0
    rule = F.when(some("direct"), "R0").when(some("back"), "R1").when(some("fits") & F.col("wild") & F.col("open"), "R3+R4").when(some("fits") & F.col("wild"), "R3").when(some("fits") & F.col("open"), "R4").when(some("fits"), "R2").otherwise("R5")
    reason = F.when(~some("in_time"), "no_flow_in_time").when(~some("ends"), "endpoint_mismatch").when(~some("fits"), "port_mismatch").otherwise("")
    way = F.when(F.col("direct") + F.col("back") + F.col("fits") == 0, "").when(some("d") & some("r"), "both").when(some("d"), "direct").otherwise("reverse")
    return out.select("id", "in_time", "ends", "fits", rule.alias("rule"), reason.alias("reason"), way.alias("direction"), (F.col("direct") != 1).alias("review"))
