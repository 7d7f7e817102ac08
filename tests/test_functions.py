"""Functions and operators that no query uses, on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paceline.functions import cells, dates, disciplines, status, text, times, urls
from paceline.operators import catalogue, freshness, quality, upsert


def each(spark, function, cases):
    """What ``function`` gives for every case, against what is expected."""
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string").select("k", function(F.col("x")).alias("y")).collect()
    assert [r.y for r in sorted(rows)] == list(cases.values())


def test_labels(spark):
    each(spark, text.normalize_label_unicode, {" Club  du \tLAC ": "club du lac", "": "", None: ""})
    each(spark, text.repair_mojibake, {"MÃ©lanie": "Mélanie", "DÃ©part â€“ Å“uvre": "Départ – œuvre", "Mélanie": "Mélanie", "plain": "plain", "œuf": "œuf", "Ã\u0081": "Ã\u0081", "Ã": "Ã", "漢字": "漢字", "": "", None: None})
    each(spark, text.is_team_name, {"Ana / Bo": True, "Ana & Bo": True, "Ana + Bo": True, "Ana Bo": False, "": False, None: False})
    each(spark, disciplines.is_relay_label, {"Triathlon M Relais": True, "Par Équipes": True, "DUO mixte": True, "Relaisse": False, "Steam": False, "": False, None: False})
    each(spark, lambda c: text.identities_differ(c, F.lit("Zoë  du-Pré")), {"PRE Du Zoe": False, "Pré Zoë": True, "": False, "!": False, None: False})
    each(spark, lambda c: status.gender_of_category(c), {"FS1": "F", "mV2": "M", "H": "M", "EQF": "", "MX": "", "S1": "", None: ""})
    each(spark, lambda c: status.gender_of_category(c, suffix=True), {"S1F": "F", "V2h": "M", "FS1": "", None: ""})
    each(spark, lambda c: urls.sub_url(c, F.lit("heat"), F.lit(3)), {"https://x.example/e//": "https://x.example/e/heat/3", "a": "a/heat/3"})


def test_dates(spark):
    each(spark, dates.iso_date, {"2024-02-29": dt.date(2024, 2, 29), "2023-02-29": None, "2024-2-9": None, "2024-02-29 ": None, None: None})
    each(spark, dates.any_date, {"2024-05-06T10:00": dt.date(2024, 5, 6), " 07/05/2024 9h": dt.date(2024, 5, 7), "dim. 8 mai 2024": dt.date(2024, 5, 8), "31/02/2024": None, "soon": None, None: None})


def test_ranks_and_times(spark):
    each(spark, lambda c: F.to_json(times.rank_pair(c)), {" 1/322": '{"rank":1,"of":"322"}', "29/SEF ": '{"rank":29,"of":"SEF"}', "7": '{"rank":7,"of":""}', "x/3": '{"of":"3"}', None: "{}"})
    each(spark, lambda c: times.ordinal(c.cast("int")), {"1": "1er", "2": "2e", "21": "21e", "0": "—", None: "—"})
    each(spark, times.rank_or_null, {"12.": 12, "0": None, "abc": None, "": None, None: None})
    each(spark, lambda c: times.rank_or_null(c, (0, 9999)), {"9999": None, "998": 998})
    each(spark, times.time_or_empty, {"1:02:03.4": "01:02:03", " 2:03,99 ": "00:02:03", "00:00:00": "", "": "", None: ""})
    got = spark.range(1).select(times.ticks(F.lit(7), F.lit(31), 10), times.ticks(F.lit(11), F.lit(19), 10), times.ticks(F.lit(10), F.lit(10), 5)).first()
    assert tuple(got) == ([10, 20, 30], [], [10])


def test_cells(spark):
    each(spark, cells.one_language, {"{DE:Startnr|EN:Bib|FR:Dos.}": "Dos.", "{de:Nr|en:Bib}": "Bib", "{DE:|ES:Hola}": "Hola", "{FR:}": "{FR:}", "{Team: Bleu}": "{Team: Bleu}", "{FR:a|free}": "{FR:a|free}", "x {FR:a}": "x {FR:a}", "": "", None: None})
    each(spark, cells.clean_cell, {"[img:https://x.example/a.png] # {EN:Men|FR:Masculin}": "Masculin", "## 12 ": "12", "\u00a0a\u00a0": "a", "Ann}": "Ann}", "": "", None: ""})
    each(spark, lambda c: F.to_json(cells.rank_and_label(c)), {"1.S4M": '{"rank":1,"label":"S4M"}', "M0M ( 12 )": '{"rank":12,"label":"M0M"}', "#3. V1": '{"rank":3,"label":"V1"}', "SEF": '{"label":"SEF"}', None: '{"label":""}'})
    each(spark, cells.without_rank, {"2:08:00 (1.)": "2:08:00", "TCN (1)": "TCN (1)", "a": "a", None: None})
    each(spark, lambda c: cells.without_rank(c, strict=False), {"2:05:29 (2)": "2:05:29", "x (y)": "x (y)"})
    whole = "<b>00:23:14</b><br/>P:2<br/><span>0.62%</span><br/><span>3.87 km/h</span>"
    each(spark, lambda c: F.to_json(cells.segment_cell(c)), {whole: '{"time":"00:23:14","rank":2,"gap":"0.62%","speed":"3.87 km/h"}', "": '{"time":"","gap":"","speed":""}', None: '{"time":"","gap":"","speed":""}'})


@pytest.mark.parametrize(("value", "size"), [(None, None), ("ALL", None), ("1", 1), (200, 200)])
def test_page_sizes(value, size):
    assert catalogue.page_size_of(value) == size


@pytest.mark.parametrize("value", [0, 201, "-1", "many"])
def test_wrong_page_sizes(value):
    with pytest.raises(ValueError):
        catalogue.page_size_of(value)


def test_people(spark):
    of = spark.createDataFrame
    known = of([(7, " Roux", "ana", None), (4, "ROUX", "Ana ", None), (9, "Roux", "Ana", dt.date(2000, 1, 2))], "id int, last_name string, first_name string, birth_date date")
    feed = of([(1, "roux", "ANA", None), (2, "Roux", "Ana", dt.date(2000, 1, 2)), (3, "Roux", None, None), (4, None, None, None)], "seq int, last_name string, first_name string, birth_date date")
    assert {r.seq: r.athlete_id for r in upsert.resolve_athletes(feed, known).collect()} == {1: 4, 2: 9, 3: None, 4: None}
    names = of([("Ana", " "), ("Ana", "Bo"), ("", ""), (None, None), ("", "Bo")], "a string, b string")
    assert [r[0] for r in names.select(upsert.reassignable("a", "b")).collect()] == [False, True, True, True, True]
    pairs = of([(1, 2), (1, 2), (3, 2), (None, 2)], "old int, new int")
    assert sorted(((r.old or 0), r.new, r.n) for r in freshness.reassignments(pairs).collect()) == [(0, 2, 1), (1, 2, 2), (3, 2, 1)]


def test_reviews(spark):
    parts = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False), (4, True, None)], "id int, is_pending boolean, is_rejected boolean")
    flags = lambda df: {r.id: (r.is_pending, r.is_rejected) for r in df.collect()}
    once = upsert.reviewed(parts, [1, 2, 3], "validate")
    assert flags(once) == {1: (False, False), 2: (False, False), 3: (False, False), 4: (True, None)} == flags(upsert.reviewed(once, [1, 2, 3], "validate"))
    assert flags(upsert.reviewed(parts, [1, 3, 4], "reject")) == {1: (True, True), 2: (True, True), 3: (False, False), 4: (True, True)}
    assert flags(upsert.reviewed(parts, [2], "unreject"))[2] == (True, False)
    with pytest.raises(ValueError, match="unknown decision"):
        upsert.reviewed(parts, [1], "delete")


def test_reconciling_and_profiles(spark):
    of = spark.createDataFrame
    at = "https://www.plata.example/resultats/evt/{}-3?heat={}".format
    sources = of([(5, at(1517534975000, "M"), "plata"), (2, at(1517534975000, "m"), "plata"), (1, at(1517534975000, "F"), "plata"), (3, "https://x.example", "other")], "course_id int, url string, provider string")
    incoming = of([("https://live.platb.example/resultats-courses/evt-1517534975000-3/M", "platb"), ("https://live.platb.example/resultats-courses/evt-1517534975000-4/M", "platb"), ("https://x.example", "other")], "url string, provider string")
    got = quality.reconcilable(sources, incoming, ["plata", "platb"]).collect()
    assert [(r.url[-3:], r.course_id) for r in got] == [("3/M", 2)]
    before, after = of([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id int, x string, y int"), of([(1, "a", 1), (2, "b", 2), (4, "d", 4)], "id int, x string, y int")
    assert [(r.id, r.before.y, r.after.y) for r in quality.changed(before, after, "id", ["x", "y"]).collect()] == [(2, None, 2)]
    feed = of([("s", "Ana", "1:00", [("a", "1")], 1, None, None, "trail"), ("s", "", None, [], None, None, 2, "trail"), ("t", None, "", None, None, None, None, None)],
              "src string, athlete_name string, total_time string, splits array<struct<label:string,time:string>>, rank_overall int, rank_category int, rank_gender int, event_type string")
    assert sorted(tuple(r) for r in quality.feed_profile(feed, "src").collect()) == [("s", 2, 1, 1, 1, 2, ["trail"]), ("t", 1, 0, 0, 0, 0, [])]


def test_plans(spark, sf):
    """Filters and columns reach the scan, absent rows are found by an anti join, and nothing is a Cartesian product."""
    from paceline.plans.bindings import Tables
    from paceline.plans.catalogue import queries

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "LeftAnti" in plan(queries()["anti_join_bibs"](spark, sf))
    for name in ("event_catalogue", "segment_chains", "historical_reclassification", "duplicate_groups", "heat_units"):
        found = plan(queries()[name](spark, sf))
        assert "CartesianProduct" not in found and "BatchEvalPython" not in found, name
    orders = Tables(spark, sf).table("orders").where("o_orderkey > 40").select("o_custkey")
    found = plan(orders)
    assert "GreaterThan(o_orderkey,40)" in found and "o_comment" not in found
