"""Rules as data, manifests, registries and keyed merges."""

from evigrain.sources import checks, scans


def test_violations(spark):
    rows = spark.createDataFrame([(1, "a", 5, ["x"], "k"), (2, None, 0, None, "k"), (3, " ", 11, ["x", "z"], None), (4, "b1", None, [], None)], "id int, name string, n int, tags array<string>, key string")
    rules = [("name", "required", None), ("name", "pattern", "^[a-z ]*$"), ("n", "at_least", 1), ("n", "at_most", 10), ("tags", "each", ["x"]), ("key", "unique", None), ("n", "one_of", [5, 11, 0])]
    found = sorted((r.id, r.path, r.message) for r in checks.violations(rows, ["id"], rules).collect())
    assert found == [(2, "key", "repeated"), (2, "n", "too small: 0"), (2, "name", "missing"), (3, "n", "too large: 11"), (3, "name", "missing"), (3, "tags", "holds a value that is not allowed"), (4, "key", "repeated"), (4, "name", "malformed: b1")]
    assert checks.violations(rows.limit(0), ["id"], rules).count() == 0


def test_overrides(spark):
    rows = spark.createDataFrame([(0, "X", "p", "tier_1_statute", "r"), (1, "X", "p", "tier_9", "r"), (2, None, "q", "tier_4_informal", "")], "row int, jurisdiction string, source_pattern string, authority_tier string, rationale string")
    found = sorted((r.row, r.path) for r in checks.override_violations(rows, "row").collect())
    assert found == [(1, "authority_tier"), (1, "jurisdiction,source_pattern"), (2, "jurisdiction"), (2, "rationale")]


def test_expected_types(spark):
    cells = spark.createDataFrame([("X", "1"), ("X", "2"), ("Y", "1"), ("X", "1")], "jurisdiction string, indicator string")
    manifest = spark.createDataFrame([("X", "1", "treaty"), ("X", "1", "treaty"), ("X", None, "case")], "jurisdiction string, indicator string, document_type string")
    found = sorted(tuple(r) for r in checks.expected_types(cells, manifest).collect())
    assert found == [("X", "1", "treaty", "indicator"), ("X", "2", "case", "jurisdiction"), ("Y", "1", "regulation", "default"), ("Y", "1", "statute", "default")]


def test_registries(spark, tmp_path):
    (tmp_path / "registry.yaml").write_text("pillars:\n  - pillar_id: '6'\n    name: Data\n    status: built\n    config_path: pillars/6.yaml\n")
    (tmp_path / "_schema.yaml").write_text("{}")
    (tmp_path / "sg.yaml").write_text("jurisdiction: SG\ndefault_expected_source_types: [statute]\nindicators:\n  '6.1':\n    expected_source_types: [treaty, statute]\n")
    assert [tuple(r) for r in scans.load_pillars(spark, f"file://{tmp_path}/registry.yaml").collect()] == [("6", "Data", "built", "pillars/6.yaml")]
    assert sorted(r.economy for r in scans.economies(spark, f"file://{tmp_path}").collect()) == ["registry", "sg"]
    assert sorted(map(str, ((r.indicator, r.document_type) for r in scans.load_manifest(spark, f"file://{tmp_path}/sg.yaml").collect()))) == ["('6.1', 'statute')", "('6.1', 'treaty')", "(None, 'statute')"]


def test_merge_keyed(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string, at int")
    state = lambda df: sorted(((r.k or "", r.v) for r in df.collect()))
    assert checks.read_keyed(spark, path) is None
    first = checks.merge_keyed(rows(("a", "1", 1), ("a", "2", 2), (None, "n", 1), ("b", "x\0y", 1)), path, ["k"], ["at"], "one")
    assert state(first) == [("", "n"), ("a", "2"), ("b", "xy")]
    spark.createDataFrame([("broken",)], "k string").write.parquet(f"{path}/data/version=2")
    assert state(checks.read_keyed(spark, path)) == [("", "n"), ("a", "2"), ("b", "xy")]
    second = rows((None, "m", 2), ("c", "3", 1), ("b", "y", 1), ("b\0", "z", 2))
    for _ in range(2):
        assert state(checks.merge_keyed(second, path, ["k"], ["at"], "two")) == [("", "m"), ("a", "2"), ("b", "z"), ("c", "3")]
    assert state(checks.merge_keyed(rows(("a", "9", 0)), path, ["k"], ["at"], "two")) == [("", "m"), ("a", "2"), ("b", "z"), ("c", "3")]
    assert state(checks.merge_keyed(rows().limit(0), path, ["k"], ["at"], "three")) == [("", "m"), ("a", "2"), ("b", "z"), ("c", "3")]
