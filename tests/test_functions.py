import pytest
from pyspark.sql import functions as F

from podium.functions import bands, text, values, weights

ALIASES = {"jake (jake dalton)": "jake", "methodz (anthony zinni)": "methodz"}


def one(frame, value, fn, kind="string"):
    return frame(f"v {kind}", (value,)).select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("name,key", [
    ("Methodz (Anthony Zinni)", "methodz"), ("Methodz", "methodz"), ("Jake (Jake Dalton)", "jake"),
    ("MethodZ (Jorge Bancells)", "methodz (jorge bancells)"), ("Jake (Jake Wellstead)", "jake (jake wellstead)")])
def test_entity_key_keeps_unknown_parentheticals(frame, name, key):
    assert one(frame, name, lambda c: text.entity_key(c, ALIASES)) == key


@pytest.mark.parametrize("place,x2", [("1", 2), ("5-6", 11), ("9-12*", 21), (">12", 26), ("DNS", None)])
def test_place_x2(frame, place, x2):
    assert one(frame, place, values.place_x2) == x2


def test_typed_values(frame):
    assert one(frame, " 1,234 ", values.to_int) == 1234
    assert one(frame, "1.5", values.to_int) is None
    assert one(frame, "WON", values.to_bool) is True
    assert one(frame, "maybe", values.to_bool) is None
    assert one(frame, "$12,500 USD", values.parse_money) == 12500


@pytest.mark.parametrize("rank,points", [(1, 1.0), (5, 0.699), (10, 0.410), (20, 0.081), (31, 0.0)])
def test_season_points(frame, rank, points):
    assert round(one(frame, rank, weights.season_points, "int"), 3) == points


def test_difference_bands(frame):
    rows = frame("d int", (-20,), (-10,), (-1,), (0,), (1,), (10,), (20,)).select(bands.difference_band(F.col("d")).alias("b")).collect()
    assert [r["b"] for r in rows] == bands.DIFFERENCE_BANDS


def test_ratio_bands(frame):
    rows = frame("g int, b int", (75, 100), (90, 100), (10, 10), (110, 100), (125, 100), (3, 0)).select(
        bands.ratio_band(F.col("g"), F.col("b")).alias("b")).collect()
    assert [r["b"] for r in rows] == bands.RATIO_BANDS


def test_title_key_collapses_repeats(frame):
    assert one(frame, "MLG_MLG Columbus & Columbus 2013", text.title_key) == "mlg columbus and columbus 2013"


def test_reception_is_bounded_and_neutral_without_score(frame):
    row = frame("s int", (40,), (-50,), (0,), (None,)).select(weights.reception_raw(F.col("s"), F.lit(40), F.lit(50)).alias("w")).collect()
    assert [r["w"] for r in row] == [1.25, 0.75, 1.0, 1.0]


def test_table_records_by_layout_and_without(spark):
    layout = text.Layout("wide", 8, 1, {"date": 0, "team": 2}, {"maps": 3, "kd": 4}, {"mode_kd": {"A": 5, "B": 6}})
    table = "\n|-\n".join([
        '{| class="x"', "| 2014 || [[Big_Event#1|The ''\'Event'\'']] || [[Red_Team]] || 12 || 1.05 || 0.9 || - || x",  # the layout
        "| [[Other Event]] || Blue || N/A || 0.8 || 3 || y",                                                       # no layout: link first
        "| May || [[A|B]] || align=\"c\" | <i>Green</i> || 7 || 1e1 || two",                                         # link second, date before it
        "|2015\n|[[Lines_Event]]\n|Team\n|4\n|1.5\n|.25\n|2\n|z", "| a || b || c || d || e || f", "| [[short]] || b", "|}"])
    df = spark.createDataFrame([(1, table, "wide"), (2, table, "other"), (3, None, "wide"), (4, "", None)], "id int, text string, kind string")
    got = {(r["id"], r["row_no"]): r for r in text.table_records(df, "text", "kind", ["id"], [layout], {"team": 1, "maps": 2, "kd": 3}).collect()}
    assert sorted(got) == [(i, n) for i in (1, 2) for n in (1, 2, 3, 4)]
    wide, first, second, lines = (got[1, n] for n in (1, 2, 3, 4))
    assert (wide["event"], wide["event_target"], wide["date"], wide["maps"], wide["kd"]) == ("The Event", "Big Event#1", "2014", 12.0, 1.05)
    assert wide["mode_kd"] == {"A": 0.9, "B": None} and first["mode_kd"] == {}
    assert (first["event"], first["event_target"], first["date"], first["team"], first["maps"], first["kd"]) == ("Other Event", "Other Event", None, "Blue", None, 0.8)
    assert (second["event"], second["event_target"], second["date"], second["team"], second["maps"], second["kd"]) == ("B", "A", "May", "Green", 7.0, 10.0)
    assert (lines["event"], lines["date"], lines["team"], lines["maps"], lines["mode_kd"]) == ("Lines Event", "2015", "Team", 4.0, {"A": 0.25, "B": 2.0})
    assert (got[2, 1]["event"], got[2, 1]["maps"], got[2, 1]["kd"]) == ("The Event", 12.0, 1.05) and got[2, 1]["mode_kd"] == {}


@pytest.mark.parametrize("value,shown", [(4.0005, 4.0), (1.0005, 1.001), (-1.0005, -1.001), (0.5125, 0.513)])
def test_half_away_rounds_the_binary_value_as_the_sql_does(frame, value, shown):
    assert one(frame, value, lambda c: values.half_away(c, 3), "double") == shown
