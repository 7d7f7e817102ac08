"""Chains, reclassification, sub-units, column roles, streams and snapshots on literal rows and against plain loops."""

import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paceline.functions import columns, splits
from paceline.operators import chains, quality, reclassification, rows, switch
from paceline.sources import heats, landed, sheets, snapshots
from paceline.streaming import landings


def chain_of(spark, *edges):
    rows = [(k, a, b, kind) for k, (a, b, kind) in enumerate(edges)]
    (r,) = spark.createDataFrame([(rows,)], f"edges array<{chains.EDGE}>").select(chains.chain("edges").alias("c")).withColumn("s", chains.chain_slots("c")).collect()
    return [e.idx for e in r.c], tuple(r.s)


def test_chains(spark):
    whole = [("-999", "1", "swim"), ("1", "2", "transition"), ("2", "3", "bike"), ("3", "4", "transition"), ("4", "999", "run")]
    assert chain_of(spark, *whole) == ([0, 1, 2, 3, 4], (0, 1, 2, 3, 4, None))
    # laps divide the bike leg; the branch of fewer segments is taken, the smaller number where both are as short
    assert chain_of(spark, *whole[:2], ("2", "lap", "bike"), ("lap", "3", "bike"), *whole[2:])[0] == [0, 1, 4, 5, 6]
    assert chain_of(spark, ("-999", "a", "run"), ("-999", "b", "bike"), ("b", "999", "run"), ("a", "999", "bike"))[0] == [0, 3]
    # circles, a loop at one place, a dead end, no way, a null end, no segments
    assert chain_of(spark, ("-999", "1", "run"), ("1", "-999", "run"), ("1", "1", "run"), ("1", "x", "run"), ("1", "999", "bike"))[0] == [0, 4]
    assert chain_of(spark, ("-999", "1", "run"), ("1", "-999", "run"), (None, "999", "run"), ("1", None, "run")) == ([], (None,) * 6)
    assert chain_of(spark) == ([], (None,) * 6)
    # run, bike, run without a swim
    assert chain_of(spark, ("-999", "1", "run"), ("1", "2", "bike"), ("2", "999", "run"))[1] == (0, None, 1, None, 2, "duathlon")


def test_segments_of_courses(spark):
    s = spark.createDataFrame([(1, 0, "-999", "1", "5", None, "A, B"), (1, 1, "1", "999", "6", None, " "), (1, 2, "-999", "999", "0", "1", "C")], "event int, idx int, a string, b string, disc string, trans string, courses string")
    s = s.withColumn("kind", chains.segment_kind("disc", "trans"))
    c = spark.createDataFrame([(1, "A"), (1, "C"), (1, None), (2, "A")], "event int, course string")
    got = {r.course: [(e.idx, e.kind) for e in r.edges] for r in chains.course_edges(s, c).collect()}
    assert got == {"A": [(0, "swim"), (1, "run")], "C": [(1, "run"), (2, "transition")], None: [(0, "swim"), (1, "run"), (2, "transition")]}


def test_reclassification_against_a_loop(spark):
    """Course after course in the order of ids, each seeing what was rewritten and merged before."""
    rng = random.Random(5)
    names, types = ["Triathlon S de Roc", "Duathlon 15 km", "Semi de Val", "Tour"], ["triathlon", "Triathlon S", "triathlon-s", "duathlon", "course-a-pied", "course-a-pied-semi", None]
    rows = [(k, rng.choice(names), rng.choice([None, "2024-01-01"]), rng.choice(types), rng.random() < 0.3, rng.choice([None, 3.0])) for k in range(160)]
    courses = spark.createDataFrame(rows, "id bigint, name string, event_date string, event_type string, is_relay boolean, distance_km double")
    new = {r.id: r.new_type for r in courses.select("id", reclassification.resolved_type("name", "event_type").alias("new_type")).collect()}
    assert new[next(r[0] for r in rows if r[1].startswith("Tri") and r[3] == "triathlon")] == "triathlon-s"
    state, home = {r[0]: list(r) for r in rows}, {r[0]: r[0] for r in rows}
    changed = 0
    for k, *_ in rows:
        row = state[k]
        if row[5] is None and row[1] == "Duathlon 15 km":
            row[5], changed = 15.0, changed + 1
        if new[k] == row[3]:
            continue
        other = [i for i, r in sorted(state.items()) if i != k and (r[1], r[2], r[3], r[4]) == (row[1], row[2], new[k], row[4])]
        if other:
            del state[k]
            home = {p: other[0] if c == k else c for p, c in home.items()}
        else:
            row[3] = new[k]
        changed += 1
    got = {r.id: list(r) for r in reclassification.reclassified(courses).collect()}
    assert got == state
    parts = spark.createDataFrame([(k, k) for k in home], "id bigint, course_id bigint")
    assert {r.id: r.course_id for r in reclassification.moved_parts(parts, courses).collect()} == home
    assert reclassification.changes(courses).first().changed == changed
    assert reclassification.reclassified(courses.limit(0)).count() == 0


CELLS = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Lien</t></is></c><c r="D1" t="s"><v>1</v></c></row>
<row r="2"><c r="A2"><v>12</v></c><c r="B2" t="str"><f>CONCAT("a","b")</f><v> ab </v></c><c r="C2" t="b"><v>1</v></c><c r="D2"><v>1.5</v></c></row>
<row r="4"><c r="A4" s="1"><v>45292.5</v></c><c t="e"><v>#N/A</v></c><c r="D4" s="2"><v>0.5</v></c></row>"""
TWIN = "Numéro,Lien,,Deux mots\n12,ab,True,1.5\n,,,\n2024-01-01 12:00:00,#N/A,,12:00:00\n"


def workbook(path, cells=CELLS):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="x" sheetId="1" r:id="rId7"/><sheet name="y" sheetId="2" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/sheet1.xml"/><Relationship Id="rId8" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Numéro</t></si><si><r><t>Deux</t></r><r><t> mots</t></r><rPh><t>yomi</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="hh:mm:ss"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")


def test_workbooks_and_tables_in_one_folder(spark, tmp_path):
    """A workbook equals its CSV twin; files of other headings and encodings, broken and empty ones lie beside them."""
    workbook(tmp_path / "a.xlsx")
    workbook(tmp_path / "empty.xlsx", "")
    (tmp_path / "b.csv").write_bytes(TWIN.encode("utf-8-sig"))
    (tmp_path / "c.CSV").write_bytes("Prénom;x,Prénom;x\n€,é,dropped\n\n1\n".encode("cp1252"))
    (tmp_path / "d.xlsx").write_bytes(b"no zip")
    (tmp_path / "e.txt").write_bytes(b"a")
    (tmp_path / "f.csv").write_bytes(b"")
    got = {}
    for r in sheets.read_sheets(spark, str(tmp_path)).orderBy("source", "n").collect():
        got.setdefault(r.source.rpartition("/")[2], []).append((r.heads, r.cells, (r.failure or "").partition(":")[0]))
    heads = ["Numéro", "Lien", "Colonne 3", "Deux mots"]
    rows = [["12", "ab", "True", "1.5"], [""] * 4, ["2024-01-01 12:00:00", "#N/A", "", "12:00:00"]]
    assert got.pop("a.xlsx") == got.pop("b.csv") == [(heads, r, "") for r in rows]
    assert got.pop("c.CSV") == [(["Prénom;x", "Prénom;x (2)"], r, "") for r in (["€", "é"], ["1", ""])]
    assert got == {"d.xlsx": [(None, None, "BadZipFile")], "e.txt": [(None, None, "ValueError")]}
    assert sheets.as_maps(sheets.read_sheets(spark, str(tmp_path / "c.CSV"))).first().cells == {"Prénom;x": "€", "Prénom;x (2)": "é"}
    with pytest.raises(ValueError, match="more than one file"):
        landed.read_table(spark, str(tmp_path))


def test_heats_are_partitions(spark, tmp_path):
    """Of ten heats one is broken and one is fresh: eight are read, one failure is a row."""
    options = "".join(f'<el-option value="h{k}"><span> Heat&nbsp;{k} </span></el-option>' for k in range(10))
    (tmp_path / "index.html").write_text(f'<select name="x"><option value="no">no</option></select><el-select name="heat"><el-option value=""><span>?</span></el-option>{options}</el-select>')
    for k in range(10):
        (tmp_path / f"h{k}.json").write_text('[{"bib": ' if k == 3 else json.dumps([{"bib": k, "time": None}, {"bib": k + 100}]))
    spark.dataSource.register(heats.HeatSource)
    df = spark.read.format("heats").option("path", str(tmp_path)).option("fresh", "h5, gone").load()
    assert df.rdd.getNumPartitions() == 9
    got = df.collect()
    assert sorted({r.heat for r in got if r.failure is None}) == [f"h{k}" for k in (0, 1, 2, 4, 6, 7, 8, 9)] and sum(r.failure is None for r in got) == 16
    assert [(r.heat, r.label, r.seq, r.cells) for r in got if r.failure] == [("h3", "Heat 3", 3, None)]
    assert next(r.cells for r in got if r.heat == "h1") == {"bib": "1", "time": None}
    assert spark.read.format("heats").option("path", str(tmp_path)).option("fresh", ",".join(f"h{k}" for k in range(10))).load().count() == 0


def test_units_without_documents(spark):
    listed = spark.createDataFrame([(1, 0, "a", "A"), (1, 1, "b", "B"), (1, 2, "c", "C"), (2, 0, "a", "A")], "source int, seq int, slug string, label string")
    docs = spark.createDataFrame([(1, "a", "["), (1, "a", '[{"n": 1}]'), (1, "c", '[{"n": 2}]'), (2, "z", "[]"), (2, "a", None)], "source int, slug string, body string")
    out = heats.units(listed, docs, spark.createDataFrame([(1, "c"), (1, "c")], "source int, slug string"), "n int")
    assert sorted((r.source, r.slug, r.state, r.rows and len(r.rows)) for r in out.collect()) == [(1, "a", "imported", 1), (1, "b", "failed", None), (1, "c", "cached", None), (2, "a", "failed", None)]
    assert sorted(tuple(r) for r in heats.trace(out).collect()) == [(1, 3, 1, 1, 1), (2, 1, 0, 0, 1)]


@pytest.mark.parametrize(
    "expression, plain",
    [
        ("[Natation]", "natation"), ("Vélo", "velo"), ("", ""), (None, ""),
        ('"#"&[BIB]', "bib"), ('ucase([SEX]) & iif([R]>0;" (" & [R] & ")")', "sex"),
        ('if([STATUS]<>2;[Vélo] & " (" & [Vélo.OVERALL.P] & ")")', "velo"),
        ("if([Relais]=1;switch(a;b);[AfficherNom])", "affichernom"), ("if([A]=1;if([B]=2;[C];[Deed]))", "deed"),
        ("OuStatut ( trim([Temps]) )", "temps"), ('icone("photos")', 'icone("photos")'), ("#[ClassementMF.p][SexeMF]", "classementmf.psexemf"),
    ],
)
def test_reduced_expressions(expression, plain):
    assert columns.plain(expression) == plain


def test_turns_are_limited(monkeypatch):
    monkeypatch.setattr(columns, "TURNS", 3)
    nested = "[Club]"
    for _ in range(5):
        nested = f'if([A]=1;{nested} & " z")'
    with pytest.raises(ValueError, match="still changes"):
        columns.reduced(nested)
    monkeypatch.undo()
    assert columns.plain(nested) == "club"


def test_column_roles(spark):
    of = lambda *f: spark.createDataFrame([("L", k, e, x, at) for k, (e, x, at) in enumerate(f)], "source string, seq int, expression string, label string, at int")
    got = columns.column_roles(of(("[NomRelais]", "Team", 3), ("AfficherNom", "Nom", 4), ("[Velo]", "Vélo", 5), ("[Finish.GUN]", "T", 6), ("CustomFlag", "Nat.", 7), ("[Natation.P]", "Rg", 8), ("[AgeGroup]", "", 9), ("[x]", "Gone", None)))
    assert sorted((r.role, r.at) for r in got.collect()) == [("category", 9), ("extra", 4), ("extra", 7), ("name", 3), ("rank_category", 9), ("segment", 5), ("time", 6)]
    assert columns.require(got, ["name", "time"]).first().places["time"] == 6
    with pytest.raises(PySparkException, match="columns missing in L: club, gender"):
        columns.require(got, ["name", "club", "gender"]).collect()
    assert columns.column_roles(of(("[a]", "A", 0)).limit(0)).count() == 0


def test_lists_without_a_column(spark):
    body = json.dumps({"DataFields": ["ID", "[Club]"], "list": {"Fields": [{"Expression": "[Club]", "Label": "C"}]}, "data": [["1", "X"]]})
    docs = spark.createDataFrame([("s", body)], "source string, body string")
    assert [(r.id, r.club) for r in landed.by_role(docs, ["club"], {"id": "ID"}).collect()] == [("1", "X")]
    with pytest.raises(PySparkException, match="columns missing in s: time"):
        landed.by_role(docs, ["club", "time"], {}).collect()


def test_shown_legs(spark):
    of = spark.createDataFrame([("duathlon-s", ["bike", "course1", "x"]), ("aquathlon", ["t1"]), (None, ["Étape T1", "T2", "À pied", "Cyclo", "Nage"]), ("trail", [])], "slug string, keys array<string>")
    got = [[(e.key, e.label, e.kind) for e in r.c] for r in of.select(splits.shown_columns("slug", "keys").alias("c")).collect()]
    assert got == [
        [("course1", "Course 1", "run"), ("bike", "Vélo", "bike")],
        [("t1", "t1", "transition")],
        [("Étape T1", "Étape T1", "other"), ("T2", "T2", "transition"), ("À pied", "À pied", "run"), ("Cyclo", "Cyclo", "bike"), ("Nage", "Nage", "other")],
        [],
    ]


DAY = dt.timedelta(days=1)


def land(path, name, *rows):
    lines = [json.dumps({"address": a, "read_at": None if day is None else f"2024-01-{day:02d}T12:00:00", "body": body}) for a, day, body in rows]
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines))


def imported(spark, source, to, state):
    stream = landings.parsed(landings.fresh_only(landings.landings(spark, source), DAY * 7, "30 days"), "n int")
    landings.import_landed(stream, to, state).awaitTermination()
    return sorted((r.address, r.read_at.day, r.doc and r.doc.n, r.failed) for r in spark.read.parquet(to).collect())


def test_fresh_addresses_across_batches(spark, tmp_path):
    """Two batches give the rows of one; started again, nothing is imported twice; what can't be read is a failure."""
    first = [("a", 1, '{"n": 1}'), ("a", 3, '{"n": 2}'), ("b", 2, '{"n"'), (None, 2, "{}"), ("c", None, "{}"), ("a", 1, '{"n": 1}')]
    second = [("a", 7, '{"n": 3}'), ("a", 8, '{"n": 4}'), ("b", 20, '{"n": 5}'), ("d", 4, '{"n": 6}'), ("a", 2, '{"n": 7}')]
    wanted = [("a", 1, 1, False), ("a", 8, 4, False), ("b", 2, None, True), ("b", 20, 5, False), ("d", 4, 6, False)]
    at = {k: str(tmp_path / k) for k in ("two", "one", "out2", "out1", "state2", "state1")}
    land(tmp_path / "two", "1.json", *first)
    assert imported(spark, at["two"], at["out2"], at["state2"]) == [w for w in wanted if w[:2] in (("a", 1), ("b", 2))]
    land(tmp_path / "two", "2.json", *second)
    assert imported(spark, at["two"], at["out2"], at["state2"]) == wanted
    assert imported(spark, at["two"], at["out2"], at["state2"]) == wanted
    land(tmp_path / "one", "1.json", *first, *second)
    assert imported(spark, at["one"], at["out1"], at["state1"]) == wanted


PARTS = "id int, course_id int, athlete_id int, bib_number string, total_time string"


def event_tables(spark):
    of = spark.createDataFrame
    courses = of([(1, "Tri", None, "triathlon", False), (2, "Duo", dt.date(2024, 5, 1), "duathlon", True)], "id int, name string, event_date date, event_type string, is_relay boolean")
    parts = of([(1, 1, 10, "1", "1:00:00"), (2, 1, 11, "2", None), (3, 2, 11, "1", "x"), (4, 1, 12, "3", "1:01:00")], PARTS)
    sources = of([(5, 1, "old", True), (6, 1, "new", False), (7, 2, "two", True)], "id int, course_id int, url string, is_active boolean")
    return {"courses": courses, "parts": parts, "sources": sources, "athletes": of([(k,) for k in (10, 11, 12, 13)], "id int")}


def fresh_rows(spark, *rows):
    return spark.createDataFrame(rows, "id int, athlete_id int, bib_number string, name string, event_date date, event_type string, course_relay boolean")


def test_source_is_switched_as_a_whole(spark, tmp_path):
    at, tables = str(tmp_path / "snapshots"), event_tables(spark)
    snapshots.publish(tables, at)
    before = snapshots.current_version(spark, at)
    same, other = ("Tri", None, "triathlon", False), ("Trail", None, "trail", False)
    held = lambda: {t: snapshots.read(spark, at, t) for t in tables}
    # nothing, or another event: refused, and what was there is there
    for rows in ([], [(9, 10, "1", *other)]):
        fresh = fresh_rows(spark, *rows)
        with pytest.raises(snapshots.Refused, match="no result" if not rows else "another event"):
            snapshots.publish(switch.switched(held(), fresh, 1, 6), at, lambda _: switch.refusal(held()["courses"], fresh, 1))
        assert snapshots.current_version(spark, at) == before and held()["parts"].count() == 4
    # a job that fails on the way leaves it too
    with pytest.raises(PySparkException):
        snapshots.publish({"parts": tables["parts"].withColumn("id", F.raise_error(F.lit("lost")).cast("int"))}, at)
    assert snapshots.current_version(spark, at) == before
    fresh = fresh_rows(spark, (8, 12, "1", *same), (9, 13, "2", *same), (9, 13, "2", *other))
    snapshots.publish(switch.switched(held(), fresh, 1, 6), at, lambda _: switch.refusal(held()["courses"], fresh, 1))
    now = held() | {"log": snapshots.read(spark, at, "log")}
    assert sorted(tuple(r)[:4] for r in now["parts"].collect()) == [(3, 2, 11, "1"), (8, 1, 12, "1"), (9, 1, 13, "2")]
    assert sorted(r.id for r in now["athletes"].collect()) == [11, 12, 13]  # 10 was only there
    assert sorted((r.id, r.is_active) for r in now["sources"].collect()) == [(5, False), (6, True), (7, True)]
    assert [tuple(r) for r in now["log"].collect()] == [("course.source.switch", 1, "old", "new", 3, 2, 1)]
    assert spark.read.parquet(f"{at}/versions/{before}/parts").count() == 4


def test_counts_of_a_write(spark, tmp_path):
    """One write tells how many times were unknown; a ranking that was cut short isn't published."""
    at, tables = str(tmp_path / "s"), event_tables(spark)
    parts, seen = snapshots.observed(tables["parts"])
    snapshots.publish({"parts": parts}, at, snapshots.cut_short(seen, 4))
    assert seen.get == {"n_rows": 4, "n_without_time": 1, "n_unknown_times": 1}
    before = snapshots.current_version(spark, at)
    parts, seen = snapshots.observed(tables["parts"].where("id < 4"))
    with pytest.raises(snapshots.Refused, match="3 rows of 4"):
        snapshots.publish({"parts": parts}, at, snapshots.cut_short(seen, 4))
    assert snapshots.current_version(spark, at) == before


def test_courses_are_deleted_with_what_hangs_on_them(spark):
    tables = event_tables(spark)
    after = switch.deleted(tables, spark.createDataFrame([(1,), (1,), (77,)], "id int"))
    assert [r.id for r in after["courses"].collect()] == [2] and [r.id for r in after["parts"].collect()] == [3] and [r.id for r in after["sources"].collect()] == [7]
    assert sorted(r.id for r in after["athletes"].collect()) == [11, 13]  # 11 is in another course, 13 never was in any
    assert [tuple(r) for r in after["log"].collect()] == [("course.delete", 1, "Tri", None, "triathlon", False, 3, 2)]
    assert {k: v.count() for k, v in switch.deleted(tables, spark.createDataFrame([], "id int")).items()} == {k: v.count() for k, v in tables.items()} | {"log": 0}


def test_courses_are_merged(spark):
    tables = event_tables(spark)
    after = switch.merged(tables, 2, 1)
    assert [r.id for r in after["courses"].collect()] == [2] and [r.id for r in after["parts"].collect()] == [3]
    assert sorted((r.id, r.course_id, r.is_active) for r in after["sources"].collect()) == [(5, 2, False), (7, 2, True)]  # the passive source of the absorbed course is gone
    assert sorted(r.id for r in after["athletes"].collect()) == [11, 13]
    (entry,) = after["log"].collect()
    assert (entry.entity_id, entry.absorbed_id, entry.absorbed_name, entry.n_deleted, entry.n_purged, entry.source_added, entry.source_url) == (2, 1, "Tri", 3, 2, True, "old")
    # an address that is known there isn't added; a course that isn't there changes nothing; nor can a course be merged with itself
    known = tables | {"sources": tables["sources"].unionByName(spark.createDataFrame([(8, 2, "old", False)], tables["sources"].schema))}
    assert sorted(r.id for r in switch.merged(known, 2, 1)["sources"].collect()) == [7, 8]
    for pair in ((2, 99), (99, 1)):
        nothing = switch.merged(tables, *pair)
        assert {k: v.count() for k, v in nothing.items()} == {k: v.count() for k, v in tables.items()} | {"log": 0}
    with pytest.raises(ValueError, match="with itself"):
        switch.merged(tables, 5, 5)


def test_import_is_finalized(spark):
    courses = spark.createDataFrame([(1, None, None), (2, dt.date(2020, 1, 1), True), (3, None, None)], "id int, scraped_at date, is_reliable_computed boolean")
    parts = spark.createDataFrame([(1, 1, "finisher", "1:00", 1, False), (2, 1, "finisher", "", 3, False), (3, 2, "?", None, None, None)], "id int, course_id int, status string, total_time string, rank_overall int, is_relay boolean")
    now = dt.date(2024, 1, 1)
    got = quality.finalized(courses, parts, spark.createDataFrame([(1,), (3,), (3,), (9,)], "id int"), F.lit(now))
    assert {r.id: (r.scraped_at, r.is_reliable_computed, r.quality_issues) for r in got.collect()} == {
        1: (now, False, {"rank_gap": 1, "finisher_without_time": 1}), 2: (dt.date(2020, 1, 1), True, None), 3: (now, False, {"no_participation": 1}),
    }


def test_splits_that_cant_be_told(spark):
    fields = [("A", "T1", "Nat", "swim", False), ("A", "T2", "Vélo", "bike", False), ("A", "T10", "Cap", "run", False), ("A", "T3", "Cap cumul", "run", True),
              ("B", "T1", "Nat", "swim", False), ("B", "T10", "Cap 2", "run", False), ("B", "T2", "Cap 1", "run", False), ("B", "T3", "Total", None, None)]
    f = spark.createDataFrame(fields, "race string, field string, label string, role string, cumulative boolean")
    times = [("T1", "00:01:00"), ("T2", ""), ("T3", "00:02:00"), ("T10", "00:03:00"), ("T11", "00:09:00")]
    v = spark.createDataFrame([(race, 1, *t) for race in "AB" for t in times] + [("A", 2, "T1", "00:00:00")], "race string, id int, field string, time string")
    got = {r.race: [tuple(s) for s in r.splits] for r in rows.planned_splits(v, f, ["race"]).collect()}
    assert got == {"A": [("swim", "00:01:00"), ("run", "00:03:00")], "B": [("Nat", "00:01:00"), ("Total", "00:02:00"), ("Cap 2", "00:03:00")]}
