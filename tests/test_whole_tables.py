"""Queries over whole tables reach every row that they should."""

from paceline.plans import bindings, catalogue

QUERIES = catalogue.queries()


def test_whatif_of_every_event(spark, sf):
    t = bindings.Tables(spark, sf)
    timed = {r.id: r.course_id for r in t.parts.where("coalesce(total_time, '') NOT IN ('', '00:00:00')").collect()}
    of = {r.id for r in t.segments.where("NOT (label = 't1' AND seconds % 2 = 1)").collect()}
    got = QUERIES["improvement_whatif"](spark, sf).select("course_id", "id").distinct().collect()
    assert {(r.course_id, r.id) for r in got} == {(c, i) for i, c in timed.items() if i in of}
    assert max(r.course_id for r in got) > 300


def test_place_of_every_course(spark, sf):
    names = {r.id: r.name for r in bindings.Tables(spark, sf).courses.collect()}
    got = {r.id: r.place for r in QUERIES["place_of_event"](spark, sf).collect()}
    assert got.keys() == names.keys()
    dated = {i: n for i, n in names.items() if n.startswith("5e ")}
    assert dated and all(got[i] == "5e " + n.removeprefix("5e Triathlon de ")[:-5] for i, n in dated.items())


def test_whole_tables_of_listings(spark, sf):
    parts = bindings.Tables(spark, sf).parts.collect()
    assert sum(r.n for r in QUERIES["left_join_counts"](spark, sf).collect()) == len(parts)
    assert {r.id for r in QUERIES["fill_gaps"](spark, sf).collect()} == {r.id for r in parts if not r.is_pending}
    elsewhere = {r.athlete_id for r in parts if r.course_id != 100}
    only = {r.athlete_id for r in parts} - elsewhere
    assert {r.athlete_id for r in QUERIES["only_on_course"](spark, sf).collect()} == only
    assert QUERIES["recent_by_event"](spark, sf).count() == 8


def test_only_on_course_of_a_few(spark):
    from paceline.operators.catalogue import only_on_course

    of = spark.createDataFrame([(1, 100), (1, 100), (2, 100), (2, 7), (3, 7)], "athlete_id long, course_id long")
    assert [r.athlete_id for r in only_on_course(of, 100).collect()] == [1]
