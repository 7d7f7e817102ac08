"""Landed files and row derivation on literal rows, and functions that no query uses."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paceline.functions import splits, status, times
from paceline.operators import rows
from paceline.sources import landed, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def docs(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "source bigint, body string")


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252"])
def test_tables(spark, tmp_path, encoding):
    (tmp_path / "t.csv").write_bytes('Nom,,Nom,Temps\n"Dupé, A", x ,1,\n"deux\nlignes",,"a ""b""",€ 01:00\n'.encode(encoding))
    got = landed.read_table(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["Nom", "Colonne 2", "Nom (2)", "Temps"]
    assert [tuple(r) for r in got.collect()] == [("Dupé, A", "x", "1", ""), ("deux\nlignes", "", 'a "b"', "€ 01:00")]


def test_empty_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("")
    assert landed.read_table(spark, str(tmp_path / "t.csv")).count() == 0


def test_folder_and_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<X>\n<E d="1" n="A"/>\n<E d="2"/>\n</X>')
    got = landed.landed(spark, str(tmp_path)).first()
    assert got.source.endswith("a.xml") and got.body.startswith("<X>\n<E")
    assert sorted(tuple(r) for r in landed.read_xml(spark, str(tmp_path), "E", "_d string, _n string").collect()) == [("1", "A"), ("2", None)]


def test_malformed_documents(spark):
    bad = docs(spark, None, "", "{", "[]", "<E", '{"DataFields": ["A"], "data": [["1"], []]}')
    assert [r.failed for r in landed.json_documents(bad, "a int").orderBy("source").collect()][:3] == [True, True, True]
    assert sorted(str(r.x) for r in landed.positional(bad, {"x": "A"}).collect()) == ["1", "None"]
    assert landed.encoded_rows(bad, 90).count() == 0
    assert landed.html_table(bad).count() == 0


def test_pages_out_of_order(spark):
    page = '{{"race": {}, "page": {}, "last": {}, "content": [{{"id": {}}}]}}'.format
    of = docs(spark, page(1, 0, "false", 1), page(1, 1, "true", 2), page(1, 2, "false", 3), page(2, 0, "false", 4), page(3, 1, "true", 5), page(4, 0, "true", 6), page(4, 0, "true", 7))
    pages = landed.numbered_pages(of, "id bigint")
    assert sorted(r.id for r in landed.rows_of_complete(pages).collect()) == [1, 2]
    assert {r.race: r.complete for r in landed.completeness(pages).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_group_levels(spark):
    of = docs(spark, '{"A": {"B": [["1"]]}, "C": [["2"], ["3"]], "D": []}', '[["4"]]', None, "x")
    got = sorted((tuple(r.labels), tuple(r.row)) for r in landed.group_tree(of).collect())
    assert got == [((), ("4",)), (("A", "B"), ("1",)), (("C",), ("2",)), (("C",), ("3",))]
    with pytest.raises(PySparkException, match="more than 1 levels"):
        landed.group_tree(of, 1).collect()


def test_pages_that_dont_close(spark):
    """A page twice, a hole, a first page that isn't 0, a page that can't be read: none of these races is complete."""
    page = lambda race, k, last=False: (f"{race}/{k}", f'{{"race": {race}, "page": {k}, "last": {str(last).lower()}, "content": [{{"id": {race * 10 + k}}}]}}')
    all_ = [page(1, 0), page(1, 0), page(1, 2, True), page(2, 0), page(2, 2, True), page(3, 0), ("3/1", '{"race": 3,'), page(3, 1, True), page(4, 0), page(4, 1, True), page(5, 1), page(5, 2, True), page(6, -1), page(6, 0, True)]
    pages = landed.numbered_pages(spark.createDataFrame(all_, "source string, body string"), "id bigint", "split_part(source, '/', 1)")
    assert {r.race: r.complete for r in landed.completeness(pages).collect()} == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False}
    assert sorted(r.id for r in landed.rows_of_complete(pages).collect()) == [40, 41]


def test_links_that_dont_close(spark):
    def page(e, k, link=None):
        more = f', "@odata.nextLink": "{link}"' if link else ""
        return f"{e}/{k}", f'{{"edition": {e}, "page": {k}, "value": [{{"rid": {e * 10 + k}}}, {{"rid": null}}]{more}}}'

    good = [page(1, 0, "x"), page(1, 1, "x"), page(1, 2), page(7, 0)]
    bad = [page(2, 0, "x"), page(2, 2), page(3, 0, "x"), page(3, 0, "x"), page(3, 1), page(4, 0), page(4, 1), page(5, 0, "x"), page(6, 0, "x"), ("6/1", "{"), page(6, 1)]
    docs_ = spark.createDataFrame(good + bad, "source string, body string")
    got = landed.linked_pages(docs_, "rid bigint", "rid", "split_part(source, '/', 1)").collect()
    assert sorted((r.edition, r.rid or 0) for r in got) == [(1, 0), (1, 0), (1, 0), (1, 10), (1, 11), (1, 12), (7, 0), (7, 70)]


def test_html_headings(spark):
    of = docs(spark, "<table><tr><th>A</th><th>A</th><th></th><th>B</th></tr><tr><td>1&amp;lt;</td><td>2</td><td>3</td><td>4</td></tr><tr><td>5</td></tr><tr></tr></table>", None)
    assert [r.cells for r in landed.html_table(of).collect()] == [{"A": "1&lt;", "B": "4"}]
    assert [tuple(r) for r in landed.uneven(of).collect()] == [(0, 1)]


def test_several_tables(spark):
    one_ = "<table class=a><tr><th>{0}</th></tr><tr><td>{1}</td></tr></table>".format
    of = docs(spark, f"<p>{one_('A', 1)}{one_('B', 2)}", f"<TABLE><tr><td>menu</td></tr><tr><td>{one_('C', 3)}</td></tr></TABLE>", "<tr><th>D</th></tr><tr><td>4</td></tr>")
    assert [r.cells for r in landed.html_table(of).orderBy("source").collect()] == [{"A": "1"}, {"C": "3"}, {"D": "4"}]
    assert [r.cells for r in landed.html_table(of, 1).collect()] == [{"B": "2"}]


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("LEVARC NoamH-S3H", ("LEVARC", "Noam", "H", "S3H")),
        ("DU PREY Ines F-V1F", ("DU PREY", "Ines", "F", "V1F")),
        ("DUPONT Jean", ("DUPONT", "Jean", "", "")),
        ("", ("", "", "", "")),
    ],
)
def test_name_cells(spark, cell, expected):
    (got,) = one(spark, rows.name_cell(F.lit(cell)))
    assert tuple(got) == expected


def test_identities(spark):
    of = lambda name, hidden, bib, relay: tuple(one(spark, rows.identity(F.lit(name), F.lit(hidden), F.lit(bib), F.lit(7), F.lit(relay)))[0])
    assert of("K... V...", True, "12", False) == ("Anonyme 7-12", "")
    assert of("Jean DUPONT", True, " ", False) == ("DUPONT", "Jean")
    assert of("Jean / Anne", False, "1", False) == ("Jean / Anne", "")
    assert of(None, None, None, None) == ("", "")


def test_times_and_names(spark):
    assert one(spark, *(rows.is_unknown_time(F.lit(x)) for x in ("", "—", "+5:16", "1:02:03", "abc"))) == (False, False, False, False, True)
    assert one(spark, rows.course_name(F.lit(" Tri  M "), F.lit(" "))) == ("Tri M",)
    with pytest.raises(PySparkException, match="without a name"):
        rows.require_names(spark.createDataFrame([("a",), (" ",)], "event_name string")).count()
    assert rows.require_names(spark.createDataFrame([("a",)], "event_name string")).count() == 1


def test_order_of_segments(spark):
    of = spark.createDataFrame([(1, 5), (2, None), (3, 4), (4, 5)], "id int, s int")
    assert [r.id for r in of.orderBy(*rows.segment_order("s", ["id"])).collect()] == [3, 1, 4, 2]
    assert [r.id for r in of.orderBy(*rows.segment_order("s", ["id"], True)).collect()] == [1, 4, 3, 2]


def test_emails(spark):
    mails = lambda *x: spark.createDataFrame([(m,) for m in x], "email string")
    assert [r.email for r in rows.known_emails(mails("A@x.fr", "b@x.fr", None), mails("a@X.fr", "a@x.fr", None)).collect()] == ["a@x.fr"]


def test_audit_ids_go_on(spark):
    log = spark.createDataFrame([(4, "a", 1)], "id bigint, action string, entity_id bigint")
    got = rows.audited(log, spark.createDataFrame([("b", 2), ("b", 3)], "action string, entity_id bigint"))
    ids = sorted(r.id for r in got.collect())
    assert ids[0] == 4 and len(set(ids)) == 3


def test_snapshot_of_courses(spark, tmp_path):
    at = str(tmp_path / "parts")
    of = lambda r: spark.createDataFrame(r, "course_id bigint, id bigint")
    sinks.write_courses(of([(c, c * 10) for c in range(8)]), at, buckets=3)
    stored = spark.read.parquet(at).drop("bucket")
    sinks.write_courses(sinks.switched(stored, of([(2, 99), (2, 98)]), buckets=3).checkpoint(), at, buckets=3)
    got = sorted(tuple(r) for r in spark.read.parquet(at).select("course_id", "id").collect())
    assert got == sorted([(c, c * 10) for c in range(8) if c != 2] + [(2, 98), (2, 99)])
    sinks.write_report(spark.read.parquet(at), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 9


def test_functions_without_a_query(spark):
    ints = lambda *x: F.array(*map(F.lit, x)).cast("array<bigint>")
    assert one(spark, splits.looks_cumulative(ints(1, 2, 3)), splits.looks_cumulative(ints(2, 1)), splits.looks_cumulative(ints(1))) == (True, False, False)
    assert one(spark, splits.nearest_point(ints(10, 20, 30), F.lit(15)), splits.next_point(ints(10, 20), F.lit(10)), splits.nearest_point(ints(), F.lit(1))) == (10, 20, None)
    assert tuple(one(spark, splits.steps_of_cumulative(ints(10, 0, 25)))[0]) == ([10, None, 15], False)
    assert tuple(one(spark, splits.steps_of_cumulative(ints(10, 5)))[0]) == ([10, 5], True)
    table = {"natation": "swim", "vélo": "bike"}
    labels = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, splits.label_slots(labels(" Natation", "VÉLO"), table), splits.label_slots(labels("Natation", "x"), table)) == (["swim", "bike"], None)
    assert one(spark, status.status_of_labels(F.lit("?"), F.lit("abd")), status.status_of_labels(F.lit(""), not_started=F.lit(True)), status.status_of_labels(F.lit(None))) == ("DNF", "DNS", "")
    assert one(spark, status.status_of_result(F.lit(""), F.lit(""), F.lit(None)), status.status_of_result(F.lit(""), F.lit(""), F.lit(3)), status.status_of_result(F.lit("dq"), F.lit("1:00"), F.lit(1))) == ("DNF", "finisher", "DSQ")
    assert one(spark, status.only_finishers(F.lit(5), F.lit("DNF")), status.only_finishers(F.lit(5), F.lit(None))) == (None, 5)
    assert one(spark, times.clock_seconds(F.lit("1:02:03")), times.clock_seconds(F.lit("2:03")), times.clock_seconds(F.lit("1:60"))) == (3723, 123, None)
