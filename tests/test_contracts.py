"""Contracts that hand-made rows show best: mixed time texts, isolated nodes, rows without history, reuse of stored tables."""

from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wattline.functions import nodes
from wattline.functions import wording as wd
from wattline.operators import clean, graph, joins, select, text, windows
from wattline.sources import readers, sinks


def test_time_texts_of_every_layout(spark):
    t = datetime(2024, 1, 2, 3, 15)
    texts = {
        "2024-01-02 03:15": t, "2024-01-02T03:15:00": t, "2024/01/02 03:15:00": t, "2024-01-02 03:15:00.5": t, "2024/1/2 3:15": t, " 2024-01-02 03:15:00 ": t,
        "2024-01-02T03:15:00Z": t, "2024.01.02 03:15": t, "2024年1月2日 3:15": t, "01/02/2024 03:15": t, "1-2-2024 3:15": t, "20240102031500": t, "202401020315": t,
        "20240102 0315": t, "20240102T031500": t, "2024-01-02 03:14:59.75": t, "2024-01-02": datetime(2024, 1, 2), "20240102": datetime(2024, 1, 2), "45293.135416667": t,
        "45293": datetime(2024, 1, 2), "2024-02-30 10:00": None, "2024-01-02 25:00": None, "n/a": None, "": None, "inf": None, None: None,
    }
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert {r.x: r.t for r in df.select("x", clean.ts_coerce(F.col("x")).alias("t")).collect()} == texts
    assert tuple(clean.ts_rejects(df, "x").first()) == (26, 2, 4)


def test_time_texts_with_zones_halves_and_month_names(spark):
    t, day = datetime(2024, 1, 2, 15, 15), datetime(2024, 1, 2)
    texts = {
        "2024-01-02 23:15:00+08:00": t, "2024-01-02T15:15:00+00:00": t, "2024-01-02T11:45:00-0330": t, "2024-01-02 23:15+08": t, "2024-01-02 15:15:00 UTC": t, "2024-01-02 15:15:00 GMT": t,
        "2024-01-02 03:15 PM": t, "01/02/2024 03:15 PM": t, "1/2/2024 3:15:00 p.m.": t, "01/02/2024, 03:15 pm": t, "2024-01-02 12:15 AM": datetime(2024, 1, 2, 0, 15), "2024-01-02 12:15 PM": datetime(2024, 1, 2, 12, 15),
        "25/12/2024 10:00": datetime(2024, 12, 25, 10), "12/25/2024 10:00": datetime(2024, 12, 25, 10), "02.01.2024 10:00": datetime(2024, 2, 1, 10), "31.01.2024": datetime(2024, 1, 31),
        "Jan 2, 2024": day, "January 2 2024 15:15": t, "2-Jan-2024 15:15": t, "2 Jan 2024": day, "02JAN2024": day, "2nd January 2024 3:15 PM": t, "Tue, 02 Jan 2024 15:15:00 GMT": t, "Tuesday, January 2, 2024 3:15 PM": t, "Sept. 2, 2024": datetime(2024, 9, 2),
        "2024-01-02 24:00": None, "2024-01-02 13:15 PM": None, "2024-01-02 0:15 AM": None, "32/13/2024": None, "13/13/2024": None, "Foo 2, 2024": None, "Feb 30, 2024": None,
    }
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert {r.x: r.t for r in df.select("x", clean.ts_coerce(F.col("x")).alias("t")).collect()} == texts


def test_a_column_votes_for_day_first(spark):
    texts = ["05/06/2024 10:00", "25/06/2024", "26.06.2024 11:00", "12/31/2024", None, "n/a", "2024-06-05"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    votes = clean.layout_votes(df, "x").first()
    assert (votes.rows, votes.year_last, votes.year_first, votes.month_only, votes.day_only, votes.day_first) == (7, 4, 1, 1, 2, True)
    got = {r.x: r.ts for r in clean.ts_read(df, "x").collect()}
    assert got["05/06/2024 10:00"] == datetime(2024, 6, 5, 10) and got["12/31/2024"] == datetime(2024, 12, 31) and got["2024-06-05"] == datetime(2024, 6, 5)
    month_first = {r.x: r.ts for r in clean.ts_read(df.where("x not like '2%'"), "x").collect()}
    assert month_first["05/06/2024 10:00"] == datetime(2024, 5, 6, 10)
    assert clean.ts_read(df.limit(0), "x").count() == 0


def test_readers_say_what_they_dropped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,n1\n2024/1/2 3:15,1\n,2\nbad,5\n", encoding="utf-8")
    seen = Observation("rejects")
    assert readers.scan_wide_matrix(spark, str(tmp_path), rejected=seen).count() == 1
    assert seen.get == {"rows": 3, "blank": 1, "rejected": 1}
    with pytest.raises(Exception, match="cannot be read: bad"):
        readers.scan_wide_matrix(spark, str(tmp_path), strict=True).collect()


def test_station_files_of_any_encoding(spark, tmp_path):
    for station, encoding in (("s1", "utf-8"), ("s2", "gb18030")):
        folder = tmp_path / f"station={station}" / "x (Nominal capacity-30MW)"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text("时间,功率\n13/01/2024 10:00,1.5\n02/01/2024 10:00,2\n02/01/2024 10:00,9\nsoon,3\n", encoding=encoding)
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    seen = Observation("stations")
    got = sorted(tuple(r) for r in readers.scan_station_dir(spark, str(tmp_path), "时间", "功率", seen).select("station", "ts", "power", "capacity").collect())
    assert got == [(s, datetime(2024, 1, d, 10), p, 30.0) for s in ("s1", "s2") for d, p in ((2, 2.0), (13, 1.5))]
    assert seen.get["rejected"] == 2 and spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_replacement_characters_are_no_error_and_columns_may_be_ordered_differently(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,v\nodd \ufffd text,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("v,name\n2,\"电,价\"\n", encoding="gb18030")
    (tmp_path / "c.csv").write_text("v,name,more\n3,x,y\n", encoding="utf-8")
    assert [(f.rsplit("/", 1)[1], e) for f, e, _ in readers.file_encodings(spark, str(tmp_path))] == [("a.csv", "UTF-8"), ("b.csv", "GB18030"), ("c.csv", "UTF-8")]
    got = sorted((r.v, r.name, r.more) for r in readers.scan_csv(spark, str(tmp_path)).collect())
    assert got == [("1", "odd \ufffd text", None), ("2", "电,价", None), ("3", "x", "y")]


def test_minute_files_lose_no_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,n1,n2\n2024/1/2 3:15,1,2\n2024-01-02T03:30,3,4\nbad,5,6\n", encoding="utf-8")
    got = sorted((r.ts, r.node_id, r.value) for r in readers.scan_wide_matrix(spark, str(tmp_path)).collect())
    assert [v for *_, v in got] == [1.0, 2.0, 3.0, 4.0]


def test_every_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,v\n电价,1\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("name,v\n负荷,2\n", encoding="gb18030")
    assert sorted((r.name, r.v) for r in readers.scan_csv(spark, str(tmp_path)).collect()) == [("电价", "1"), ("负荷", "2")]
    (tmp_path / "c.csv").write_bytes(b"name,v\n\xff\xfe\xff,3\n")
    with pytest.raises(ValueError, match="decodes"):
        readers.scan_csv(spark, str(tmp_path), encodings=("UTF-8",))


def test_nodes_without_neighbours_get_zero(spark):
    obs = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 5.0), ("c", 0, 7.0)], "n string, t long, v double")
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "gone", 1.0), ("c", "c", 2.0)], "src string, dst string, weight double")
    got = {r.n: r.nbr for r in graph.neighbour_mean(edges, obs, "n", "t", "v").collect()}
    assert got["a"] == pytest.approx(2.5) and got["b"] == 0 and got["c"] == 0


def test_correlations_over_several_node_parts(spark):
    rows = [(f"n{k}", t, float((t * (k + 3)) % 11 + k * t)) for k in range(9) for t in range(40)]
    obs = spark.createDataFrame(rows, "n string, t long, v double")
    one, many = ({(r.src, r.dst): r.weight for r in graph.corr_graph(obs, "n", "t", "v", rows_per_block=16, nodes_per_part=p).collect()} for p in (100, 2))
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)


def test_tags_of_sparse_nodes(spark):
    starts = spark.createDataFrame([(k, 10 + k) for k in range(4)], "win long, t_start long")
    ids = spark.createDataFrame([(70,), (5,), (900_000,)], "node_idx long")
    got = sorted((r["item"], r.win, r.node_idx) for r in windows.tag_nodes(starts, ids).collect())
    assert got == [(w * 3 + i, w, n) for w in range(4) for i, n in enumerate((5, 70, 900_000))]
    assert sorted(r["item"] for r in windows.tag_nodes(starts, ids, cap=5).collect()) == list(range(5))
    assert windows.tag_nodes(starts, ids.limit(0)).count() == 0


def test_history_hits_and_misses(spark):
    frame = spark.createDataFrame([(datetime(2024, 1, d), float(d)) for d in range(1, 6)], "ts timestamp_ntz, temperature double")
    w = spark.createDataFrame([(0, 1, datetime(2024, 1, 3)), (2, 1, datetime(2024, 3, 1)), (99, 1, datetime(2024, 3, 1)), (0, 2, None)], "t_start long, node_idx long, history_end_ts timestamp_ntz")
    got = {(r.t_start, r.node_idx): r.temperature for r in joins.lookup_history_end(w, frame, ["temperature"]).collect()}
    assert got == {(0, 1): 3.0, (2, 1): 2.0, (99, 1): 5.0, (0, 2): 1.0}


def test_best_items_have_positions(spark):
    items = spark.createDataFrame([(k, 1.0) for k in range(20)] + [(99, 2.0)], "k long, score double")
    for got in (select.keep_best(items, ["k"], 0.0, most=3), select.keep_best(items, ["k"], 3 / 21)):
        assert sorted((r.pos, r.k) for r in got.collect()) == [(1, 99), (2, 0), (3, 1)]


def test_labels_in_title_case(spark):
    df = spark.createDataFrame([("north-pole site/west", "North-Pole Site/West"), ("  Old MILL ", "Old Mill"), ("", None)], "a string, b string")
    assert all(r.x == r.b for r in df.select("b", nodes.domain_label(F.col("a")).alias("x")).collect())


def row_without_history(spark, **columns):
    profile = F.struct(F.lit("occupancy").alias("series_label"), F.lit("EV").alias("domain"), F.lit("forecaster").alias("role"), F.lit("occupancy values").alias("noun"))
    base = spark.createDataFrame([(1, 1, [0.1, 0.2, 0.3, 0.4], [0.5, 0.6], None, None, None, None, None), (1, 2, [0.1, 0.2, 0.3, 0.4], [0.5, 0.6], "  Ref 1", 0.3, "Diff T: +0.100", 0.2, "rising")],
                                 "t_start long, node_idx long, x_hist array<double>, y array<double>, retrieved_block string, retrieved_last_value double, diff_text string, nbr double, retrieved_trend_label string")
    base = base.withColumn("static_text", F.lit(None).cast("string"))
    for c in ("retrieved_short_slope", "retrieved_medium_slope", "retrieved_mean", "diff_occ"):
        base = base.withColumn(c, F.when(F.col("node_idx") == 2, F.lit(0.1)))
    return text.with_trends(base).withColumn("profile", profile).withColumns({k: F.lit(v) for k, v in columns.items()})


def test_prompts_of_rows_without_history(spark):
    rows = row_without_history(spark)
    got = {(r.node_idx, r.style): r.user_text for r in text.prompt_rows(rows, [("direct", "absolute"), ("staged", "absolute"), ("vanilla", "absolute")], 2).collect()}
    for style in ("direct", "staged"):
        bare, full = got[1, style], got[2, style]
        assert "Retrieved similar examples:\n  (none)\n\n" in bare and "Retrieved similar examples:\n  Ref 1\n\n" in full
        assert wd.FLAT_GUARD[False] in bare and wd.FLAT_GUARD[True] in full
        assert wd.DIFF_NONE in bare and "Environmental differentials: Diff T: +0.100\n\n" in full
        assert "Retrieved last value" not in bare and "Retrieved last value: 0.300" in full
        assert "Neighbour" not in bare.split("Forecast horizon")[0] and "Neighbour occupancy (last step): 0.200" in full
    assert "Retrieved similar" not in got[1, "vanilla"]


def test_targets_of_rows_without_neighbours(spark):
    rows = row_without_history(spark)
    short = {r.node_idx: r.t for r in rows.select("node_idx", text.target_text(True, 2, short_beyond=1).alias("t")).collect()}
    assert wd.NEIGHBOUR_TARGET_NONE in short[1] and "Neighbour mean occupancy (last step): 0.200.\n" in short[2]
    assert f"Environmental differentials: {wd.DIFF_NONE}\n" in short[1]
    staged = {r.node_idx: r.t for r in rows.select("node_idx", text.target_text(True, 2, differentials=False).alias("t")).collect()}
    assert "Neighbour mean occupancy (last step): 0.250" in staged[1] and "differentials" not in staged[1]


def test_static_lines(spark):
    df = spark.createDataFrame([("n1", None, "CBD", "", 12.34567, "kW"), ("grid_7", None, "CBD", None, None, ""), ("n2", "Mall", "CBD", None, 3.0, None), (None, None, None, None, None, None)],
                               "node_id string, site_type string, zone_type string, poi_summary string, capacity double, unit string").withColumn("profile", F.struct(F.lit("Grid power").alias("domain")))
    got = [r[0] for r in df.select(text.static_block(df.columns, dict(df.dtypes))).collect()]
    head = "Static station context:\n"
    assert got == [head + "Node id: n1\nZone type: CBD\nNode capacity: 12.346\nUnit: kW", head + "Node id: grid_7\nSignal type: Grid power", head + "Node id: n2\nSite type: Mall\nNode capacity: 3.0", ""]


def test_candidate_interval_and_horizon(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 1.5, 9.0], [1.5, 2.5, 9.0], [1.0, 0.0, 1.0]), (None, None, None, None)], "c array<double>, lo array<double>, hi array<double>, m array<double>")
    got = [r[0] for r in df.select(text.candidate_block(F.col("c"), F.col("m"), F.col("lo"), F.col("hi"), horizon=2)).collect()]
    assert got[0].startswith("Candidate forecast (2 steps): [1.000, 2.000]\n") and "lower_mean=1.000, upper_mean=2.000, avg_width=1.000\nCandidate refine steps: [0]" in got[0] and got[1] == ""


def test_a_build_cut_short_is_never_reused(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build(n, fail=False):
        def run():
            calls.append(n)
            df = spark.range(n)
            return df.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id"))) if fail else df
        return run

    assert sinks.load_or_build(spark, path, {"n": 3}, build(3))[1] is False
    with pytest.raises(Exception, match="stop"):
        sinks.load_or_build(spark, path, {"n": 5}, build(5, fail=True))
    old, reused = sinks.load_or_build(spark, path, {"n": 3}, build(99))
    assert reused and old.count() == 3
    new, reused = sinks.load_or_build(spark, path, {"n": 5}, build(5))
    assert not reused and new.count() == 5 and calls == [3, 5, 5]


def test_retrieval_store_checks_its_parameters(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(ValueError, match="no finished"):
        sinks.scan_retrieval(spark, path)
    sinks.sink_retrieval(spark.range(4), path, parameters={"k": 2, "version": "shape"})
    assert sinks.scan_retrieval(spark, path, {"k": 2}).count() == 4
    with pytest.raises(ValueError, match="k=2"):
        sinks.scan_retrieval(spark, path, {"k": 3})


def test_shared_parts_of_prompts_are_rendered_once(spark):
    """Numbers are rendered before the rows are multiplied, and all prompts still are those of ``prompt_columns``."""
    rows = row_without_history(spark)
    variants = [(s, m) for s in ("vanilla", "direct") for m in ("absolute", "residual", "selective_residual", "chunk_offset")] + [("staged", "absolute")]
    out = text.prompt_rows(rows, variants, 2)
    got = {(r.node_idx, r.style, r["mode"]): (r.system_text, r.user_text) for r in out.collect()}
    for style, mode in variants:
        system, user = text.prompt_columns(rows.columns, style, mode, 2)
        for r in rows.select("node_idx", system.alias("s"), user.alias("u")).collect():
            assert got[r.node_idx, style, mode] == (r.s, r.u)
    assert len(got) == 2 * len(variants)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("lambdafunction" not in line for line in plan.splitlines() if "Generate" in line)


def test_targets_are_made_before_the_rows_are_multiplied(spark):
    from wattline.plans import q_text

    df = q_text.target_kinds(row_without_history(spark))
    assert sorted({r.kind for r in df.collect()}) == ["list", "short", "staged"] and df.count() == 6
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("lambdafunction" not in line for line in plan.splitlines() if "Generate" in line)
