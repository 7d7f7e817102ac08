"""Chains of segments: the way from start to finish through a course's checkpoints, and the slots that its parts fill.

A timing service publishes segments as edges between checkpoints, for several courses together: whole legs beside the laps that
divide them. The chain of fewest segments takes the legs and leaves the laps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.text import bound, of

#: The checkpoints at which every course begins and ends.
START, FINISH = "-999", "999"
#: Codes of disciplines; a transition has its own mark or this code.
KINDS = {"5": "swim", "0": "bike", "6": "run"}
TRANSITION, NO_DISCIPLINE = "transition", "-1"
EDGE = "struct<idx:int,a:string,b:string,kind:string>"
STEP = "struct<node:string,path:array<int>>"


def segment_kind(discipline: Column | str, is_transition: Column | str) -> Column:
    code = F.coalesce(of(discipline), F.lit(""))
    kind = F.when((F.coalesce(of(is_transition), F.lit("")) == "1") | (code == NO_DISCIPLINE), F.lit(TRANSITION))
    for number, name in KINDS.items():
        kind = kind.when(code == number, F.lit(name))
    return kind.otherwise(F.lit("other"))


def course_edges(segments: DataFrame, courses: DataFrame) -> DataFrame:
    """``event, course, edges``: the segments (``event, idx, a, b, kind, courses``) that hold for each course (``event, course``).

    ``courses`` lists a segment's courses, comma-separated; an empty list means all, and a course without a name has every segment.
    """
    names = F.filter(F.transform(F.split(F.coalesce("courses", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    edge = F.struct(F.col("idx").cast("int").alias("idx"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "kind")
    own = segments.select("event", names.alias("names"), edge.alias("edge"))
    fits = (F.size("names") == 0) | (F.coalesce("course", F.lit("")) == "") | F.array_contains("names", F.coalesce("course", F.lit("")))
    both = courses.select("event", "course").distinct().join(own, "event").where(fits)
    return both.groupBy("event", "course").agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def chain(edges: Column | str, start: str = START, finish: str = FINISH) -> Column:
    """Segments on the way of fewest segments, as an array of ``idx, a, b, kind``; empty if no way leads to the finish.

    Among ways of equal length the one with the smallest ``idx`` at the first segment that differs. All checkpoints that are one segment farther are found
    in each round, and none twice; so circles end, and the work is bounded by segments times checkpoints.
    """
    return bound(of(edges).cast(f"array<{EDGE}>"), lambda e: way_through(e, start, finish))


def way_through(edges: Column, start: str, finish: str) -> Column:
    """`chain` of edges that are at hand."""
    none = F.array().cast(f"array<{STEP}>")
    first = F.array(F.struct(F.lit(start).alias("node"), F.array().cast("array<int>").alias("path"))).cast(f"array<{STEP}>")
    begin = F.struct(first.alias("front"), F.array(F.lit(start)).cast("array<string>").alias("seen"), F.lit(None).cast("array<int>").alias("found"))

    def onward(step: Column) -> Column:
        out = F.filter(edges, lambda e: e["a"] == step["node"])
        return F.transform(out, lambda e: F.struct(e["b"].alias("node"), F.concat(step["path"], F.array(e["idx"])).alias("path")))

    def reach(held: Column, step: Column) -> Column:
        new = F.struct(F.concat(held["front"], F.array(step)).cast(f"array<{STEP}>").alias("front"), F.concat(held["seen"], F.array(step["node"])).cast("array<string>").alias("seen"))
        return F.when(step["node"].isNull() | F.array_contains(held["seen"], F.coalesce(step["node"], F.lit(""))), held).otherwise(new)

    def round_(held: Column, _: Column) -> Column:
        empty = F.struct(none.alias("front"), held["seen"].alias("seen"))
        new = F.aggregate(F.flatten(F.transform(held["front"], onward)).cast(f"array<{STEP}>"), empty, reach)
        met = F.get(F.filter(new["front"], lambda s: s["node"] == finish), F.lit(0))["path"]
        return F.struct(new["front"].alias("front"), new["seen"].alias("seen"), F.coalesce(held["found"], met).cast("array<int>").alias("found"))

    rounds = F.transform(edges, lambda e, k: k)
    path = F.aggregate(rounds, begin, round_)["found"]
    return F.coalesce(F.transform(path, lambda i: F.get(F.filter(edges, lambda e: e["idx"] == i), F.lit(0))), F.array().cast(f"array<{EDGE}>"))


def chain_slots(of_chain: Column | str) -> Column:
    """``struct(swim, t1, bike, t2, run, event_type)``: the ``idx`` that fills each slot, and the type that the chain forces, if any.

    The first segment of a kind fills its slot. Run, bike, run without a swim is a duathlon, whose first run stands in the slot of the swim.
    The first two transitions are t1 and t2, whatever lies between them.
    """
    c = of(of_chain)
    idx = lambda kind, k=0: F.get(F.filter(c, lambda e: e["kind"] == kind), F.lit(k))["idx"]
    legs = F.transform(F.filter(c, lambda e: e["kind"] != TRANSITION), lambda e: e["kind"])
    two_runs = F.coalesce(F.array_join(legs, ">") == "run>bike>run", F.lit(False))
    return F.struct(
        F.when(two_runs, idx("run")).otherwise(idx("swim")).alias("swim"),
        idx(TRANSITION).alias("t1"),
        idx("bike").alias("bike"),
        idx(TRANSITION, 1).alias("t2"),
        F.when(two_runs, idx("run", 1)).otherwise(idx("run")).alias("run"),
        F.when(two_runs, F.lit("duathlon")).alias("event_type"),
    )
