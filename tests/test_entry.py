import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert all(isinstance(v, str) and v for v in entry.oracle_sql().values())


def test_core_does_not_know_the_training_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent / "waymark"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
