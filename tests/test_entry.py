import __spark_entry__ as entry


def test_queries_and_sql_agree_on_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_import_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "orfspark"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
