"""Text input end to end: one row for each lenient rule, expected rows derived by hand."""

import pytest
from pyspark.sql import functions as F

from kinweave import cli, plans, sinks, sources, timing
from kinweave.functions import fields, to_int, trim_controls

PAGES = "1,Ana,Engineer,10,Chess\n2,Ben,Teacher,10,chess\n3,Cyd,Baker,10,Hiking\n4,Dee,Pilot,20,Chess \n5,Eli,Nurse,20,\n6,Fay,Cook,x,Go\n7,Gus,Smith,y,Go,extra\nbad\n"
FOLLOWS = "1,1,2,5,f\n2,2,1,6,f\n3,1,3,7,f\n4,1,3,8,f\n5,3,4,9,f\n6,4,5,9,f\n7,5,5,9,f\n8,9,1,9,f\n9,6,7,9,f\n10,7\n" + "".join(f"{i},2,99,9,f\n" for i in range(11, 19))
ACTIVITY = "1,1,2,viewed,10000\n2,1,2,noted,9000\n3,1,99,viewed,5\n4,2,1,viewed,7840\n5,4,2,viewed,7841\n6,0,1,viewed,10001\n7,3,abc,viewed,9999\n8,5,2,viewed,-4\n9,6,1,viewed\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("text")
    out = {}
    for name, text in (("pages", PAGES), ("follows", FOLLOWS), ("activity", ACTIVITY), ("empty", "")):
        (d / name).write_text(text)
        out[name] = str(d / name)
    return out


@pytest.fixture(scope="module")
def tables(spark, files):
    return {
        "rows": sources.read_page_rows(spark, files["pages"]),
        "pages": sources.read_pages(spark, files["pages"]),
        "follows": sources.read_follows(spark, files["follows"]),
        "activity": sources.read_activity(spark, files["activity"]),
        "no_follows": sources.read_follows(spark, files["empty"]),
        "no_activity": sources.read_activity(spark, files["empty"]),
    }


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def test_a(spark, files, tables):
    assert bag(plans.hobby_frequency(tables["rows"])) == [("Chess", 2), ("Go", 2), ("Hiking", 1), ("chess", 1)]
    strict = sources.read_page_rows(spark, files["pages"], strict=True)
    assert bag(plans.hobby_frequency(strict, strict=True)) == [("Chess", 1), ("Chess ", 1), ("Go", 1), ("Hiking", 1), ("chess", 1)]


def test_b(tables):
    got = [tuple(r) for r in plans.top_pages(tables["pages"], tables["activity"]).collect()]
    assert got == [(2, "Ben", "Teacher", 4), (1, "Ana", "Engineer", 3), (99, "", "", 1)]


def test_b_ties(spark, tables):
    visits = spark.createDataFrame([(i, i) for i in range(12, 0, -1)], "by_who bigint, what_page bigint")
    assert [r.id for r in plans.top_pages(tables["pages"], visits).collect()] == list(range(1, 11))
    assert [r.id for r in plans.top_pages(tables["pages"], visits, k=3).collect()] == [1, 2, 3]


def test_c(tables):
    assert bag(plans.users_by_hobby(tables["rows"], "CHESS")) == [("Ana", "Engineer"), ("Ben", "Teacher"), ("Dee", "Pilot")]
    assert bag(plans.users_by_hobby(tables["rows"], "")) == [("Eli", "Nurse")]
    assert bag(plans.users_by_hobby(tables["rows"], " Chess\t")) == bag(plans.users_by_hobby(tables["rows"], "chess"))
    assert bag(plans.users_by_hobby(tables["rows"], "  ")) == [("Eli", "Nurse")]


@pytest.mark.parametrize("strategy", [None, "broadcast", "merge", "shuffle_hash"])
def test_d_e_f_g_h(tables, strategy):
    t = tables
    d = {r.id: r.n for r in plans.follower_totals(t["pages"], t["follows"], strategy).collect()}
    assert d == {1: 2, 2: 1, 3: 2, 4: 1, 5: 2, 6: 0, 7: 1}
    e = {r.id: (r.total_actions, r.distinct_pages) for r in plans.activity_totals(t["pages"], t["activity"], strategy).collect()}
    assert e == {1: (3, 2), 2: (1, 1), 3: (0, 0), 4: (1, 1), 5: (1, 1), 6: (1, 1), 7: (0, 0)}
    assert [r[0] for r in bag(plans.above_average(t["pages"], t["follows"], strategy=strategy))] == [1, 3, 5]
    assert bag(plans.above_average(t["pages"], t["follows"], "rows", strategy=strategy)) == []
    assert [r[0] for r in bag(plans.outdated(t["pages"], t["activity"], strategy=strategy))] == [2, 5, 6, 7]
    for plan in ("pair", "anti"):
        assert [r[0] for r in bag(plans.one_way_in_region(t["pages"], t["follows"], plan, strategy))] == [1, 4, 6]


def test_empty(tables):
    t = tables
    assert plans.outdated(t["pages"], t["no_activity"]).count() == 7
    assert {r.n for r in plans.follower_totals(t["pages"], t["no_follows"]).collect()} == {0}
    assert plans.above_average(t["pages"], t["no_follows"]).count() == 0
    assert plans.one_way_in_region(t["pages"], t["no_follows"]).count() == 0
    assert plans.top_pages(t["pages"], t["no_activity"]).count() == 0


def test_properties(spark, tables):
    t = tables
    assert sum(r.n for r in plans.hobby_frequency(t["rows"]).collect()) == 6
    wide = {r[0] for r in bag(plans.outdated(t["pages"], t["activity"], 10_000))}
    assert wide <= {r[0] for r in bag(plans.outdated(t["pages"], t["activity"], 1))}
    edges = t["follows"].select("id1", "id2").where("id2 is not null")
    back = edges.selectExpr("id2 as id1", "id1 as id2")
    assert plans.one_way_in_region(t["pages"], edges.union(back)).count() == 0
    assert bag(plans.one_way_in_region(t["pages"], edges.union(edges))) == bag(plans.one_way_in_region(t["pages"], edges))


def test_unknown_choices(tables):
    with pytest.raises(ValueError):
        plans.follower_totals(tables["pages"], tables["follows"], "nested")
    with pytest.raises(ValueError):
        plans.above_average(tables["pages"], tables["follows"], "median")
    with pytest.raises(ValueError):
        plans.one_way_in_region(tables["pages"], tables["follows"], "xor")


def test_functions(spark):
    texts = ["1.5", "", "abc", "1e3", "2147483648", " 7\t", "+5", "-3", "007", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(to_int(df.x, -1, "int")).collect()] == [-1, -1, -1, -1, -1, 7, 5, -3, 7, -1]
    assert spark.createDataFrame([('a,"b,c",,',)], "x string").select(fields("x")).first()[0] == ["a", '"b', 'c"', "", ""]
    assert spark.createDataFrame([("\t a b\x01",)], "x string").select(trim_controls(F.col("x"))).first()[0] == "a b"


def test_repeated_ids_keep_one_row(spark, tmp_path):
    (tmp_path / "p").write_text("1,Ana,E,1,x\n1,Zoe,F,2,y\n")
    assert [tuple(r) for r in sources.read_pages(spark, str(tmp_path / "p")).collect()] == [(1, "Zoe", "F", 2, "y")]


def test_cli_and_sink(spark, files, tmp_path, monkeypatch):
    monkeypatch.setenv(timing.ENVIRONMENT, str(tmp_path / "times.csv"))
    expected = {"a": "chess\t1", "b": "99,,,1", "c": "Ana\tEngineer", "d": "6,Fay,0", "e": "1\t3,2", "f": "5,Eli,2", "g": "7,Gus", "h": "6,Fay"}
    for q, line in expected.items():
        a = cli.parser().parse_args([q, "--pages", files["pages"], "--follows", files["follows"], "--activity", files["activity"], "--hobby", "chess", "--out", str(tmp_path / q)])
        with timing.timed(f"question_{q}"):
            sinks.write_text(cli.answer(spark, a), q, a.out)
        assert line in [r[0] for r in spark.read.text(a.out).collect()]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_text(cli.answer(spark, a), q, a.out)
    log = (tmp_path / "times.csv").read_text().splitlines()
    assert log[0] == ",".join(timing.HEADER) and len(log) == 9 and all(x.endswith(",1") for x in log[1:])
    with pytest.raises(RuntimeError), timing.timed("broken"):
        raise RuntimeError
    assert (tmp_path / "times.csv").read_text().splitlines()[-1].endswith(",0")
    for wrong in (["d", "--pages", files["pages"], "--out", "x"], ["z"], []):
        with pytest.raises(SystemExit) as end:
            cli.main(wrong)
        assert end.value.code == 1


def test_main_logs_job_and_total(spark, files, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv(timing.ENVIRONMENT, "  ")  # a blank name stands for the default
    assert cli.main(["c", "--pages", files["pages"], "--hobby", " Chess ", "--out", str(tmp_path / "c")]) == 0
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "c")).collect()) == ["Ana\tEngineer", "Ben\tTeacher", "Dee\tPilot"]
    rows = [x.split(",") for x in (tmp_path / "task_times.csv").read_text().splitlines()]
    assert rows[0] == timing.HEADER and [r[1:3] for r in rows[1:]] == [["question_c", "job"], ["question_c", "total"]]
    assert all(int(r[3]) >= 0 and float(r[4]) >= 0 and r[5] == "1" for r in rows[1:]) and int(rows[1][3]) <= int(rows[2][3])
    said = capsys.readouterr().out
    assert "question_c time_ms=" in said and "question_c total_time_ms=" in said


def test_split_on_tabs(spark):
    assert spark.createDataFrame([("a\tb,c\t\t",)], "x string").select(fields("x", "\t")).first()[0] == ["a", "b,c", "", ""]


def test_numbers_without_regular_expressions(spark):
    """What counts as an integer: signed ASCII digits, with any characters up to U+0020 around them."""
    texts = ["7", " 7\t", "\x00\x1f7 \n", "+5", "-5", "--5", "+", "-", "", " ", None, "1.0", "1.", ".5", "1e3", "0x1", "7\x7f", "\x7f7", "7\xa0", "٣", "1 2", "1_0", "007", "99999999999", "9223372036854775807", "9223372036854775808"]

    def plain(t, bits):
        t = (t or "").strip("".join(map(chr, range(33))))
        digits = t[1:] if t[:1] in ("+", "-") else t
        return int(t) if digits and set(digits) <= set("0123456789") and -(1 << bits - 1) <= int(t) < 1 << bits - 1 else None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(to_int(F.col("t")).alias("a"), to_int(F.col("t"), -1, "int").alias("b"), trim_controls(F.col("t")).alias("c")).collect()
    assert [r.a for r in got] == [plain(t, 64) for t in texts]
    assert [r.b for r in got] == [-1 if plain(t, 32) is None else plain(t, 32) for t in texts]
    assert [r.c for r in got] == [None if t is None else t.strip("".join(map(chr, range(33)))) for t in texts]
