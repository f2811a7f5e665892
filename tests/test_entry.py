"""The driver contract: entry() runs the flagship on sf0.001 with a stable schema; keys line up."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_and_registry(spark):
    e = _entry_module()
    a, b = e.entry(spark), e.entry(spark)
    assert a.schema == b.schema
    assert a.count() == 150  # one row per campaign at sf0.001
    from pacewise.plans.catalog import QUERIES

    assert set(QUERIES) <= set(e.oracle_sql()) <= set(e.queries())
