import inspect

from chronogrid.operators import mice
from chronogrid.plans import queries


def test_impute_mice_runs_all_rounds(monkeypatch):
    """The registered query takes the operator's own number of rounds."""
    default = inspect.signature(mice.impute).parameters["max_iter"].default
    asked = []
    monkeypatch.setattr(queries.mice, "impute", lambda panel, **options: asked.append(options) or panel)
    monkeypatch.setattr(queries.derived, "gappy", lambda spark, d: type("P", (), {"df": _Any(), "with_df": lambda s, *a: s, "map": lambda s, f: s})())
    monkeypatch.setattr(queries, "_rounded", lambda p, digits: p)
    monkeypatch.setattr(queries, "F", _Any())
    queries._mice(None, "")
    assert asked[0].get("max_iter", default) == default == 10


class _Any:
    def __getattr__(self, name):
        return lambda *a: _Any()

    def __mod__(self, other):
        return self
