import importlib
import sys


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_package(monkeypatch):
    """As if the subpackage and the pipeline weren't there: everything else is."""
    for name in [m for m in sys.modules if m.startswith("earshot.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name == "earshot.llm" or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone, *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    names = e.queries()
    assert "signals_threshold" in names and not any(n.startswith("op1_") or n == "pipeline" for n in names)
    assert set(e.oracle_sql()) <= set(names)
