from recordloom.sources import catalogue


def test_plausible_datasets_once(spark):
    four = ["a", "b", "c", "d"]
    rows = [
        ("data.elm.gov", "ab12-cd34", "b", four), ("data.elm.gov", "ab12-cd34", "a", four), ("10.0.0.1", "ab12-cd34", "x", four),
        (".elm.gov", "ab12-cd34", "x", four), ("elm.gov.", "ab12-cd34", "x", four), ("localhost", "ab12-cd34", "x", four), ("Data.elm.gov", "ab12-cd34", "x", four),
        ("data.elm.gov", "AB12-cd34", "x", four), ("data.elm.gov", "ab12-cd3", "x", four), ("data.elm.gov", "ab12-cd35", "x", four[:3]), (None, None, None, None),
    ]
    got = catalogue.discovered(spark.createDataFrame(rows, "domain string, dataset_id string, name string, columns array<string>")).collect()
    assert [(r["domain"], r["dataset_id"], r["name"]) for r in got] == [("data.elm.gov", "ab12-cd34", "a")]


def test_examples_hold_the_first_values(spark):
    rows = [("s", i, "owner", v) for i, v in enumerate(["", "Ann", None, "Bo", "Cy", "Di"])] + [("s", 0, "empty", " ")]
    cells = spark.createDataFrame(rows, "source_id string, record long, label string, value string")
    assert [tuple(r) for r in catalogue.column_examples(cells).collect()] == [("s", "owner", ["Ann", "Bo", "Cy"])]
    assert catalogue.column_examples(cells.limit(0)).count() == 0
