"""Chip windows of scenes: the first of each are made, without the others."""


def test_chips_of_wide_and_shared_scenes(spark):
    from terraloom.sources.scan import chip_grid

    scenes = [(1, 700, 400, 10.0, 50.0), (2, 255, 900, 0.0, 0.0), (3, 256, 256, 5.0, 5.0), (4, 600, 300, 1.0, 1.0), (4, 300, 800, 2.0, 2.0), (None, 300, 300, 0.0, 1.0)]
    df = spark.createDataFrame(scenes, "scene_id long, width int, height int, west double, north double").selectExpr("*", "0.5 as pixel")
    for most in (0, 1, 4, 1000):
        want = []
        for i in (1, 2, 3, 4, None):
            mine = [(r, c, w + (c + 128) * 0.5, n - (r + 128) * 0.5) for k, wide, high, w, n in scenes if k == i for r in range(0, high - 255, 128) for c in range(0, wide - 255, 128)]
            want += [(i, *x) for x in sorted(mine)[:most]]
        got = [(r["scene_id"], r["row"], r["col"], r["lon"], r["lat"]) for r in chip_grid(df, 256, 128, most).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_vast_scene_gives_its_first_chips(spark):
    from terraloom.sources.scan import chip_grid

    df = spark.createDataFrame([(7, 2_000_000_000, 2_000_000_000, 0.0, 0.0, 1e-9)], "scene_id long, width int, height int, west double, north double, pixel double")
    assert [(r["row"], r["col"]) for r in chip_grid(df, 256, 128, 3).orderBy("row", "col").collect()] == [(0, 0), (0, 128), (0, 256)]
