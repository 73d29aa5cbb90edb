import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_every_library_query_runs(spark):
    from lexmesh import catalog

    for name, run in catalog.queries().items():
        assert run(spark, SF).count() > 0, name


def test_entry_module_has_both(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for path in [*root.glob("lexmesh/**/*.py"), *root.glob("tools/*.py")]:
        if "llm" not in path.parts:
            assert "lexmesh.llm" not in path.read_text(), path
