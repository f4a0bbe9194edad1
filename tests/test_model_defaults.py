"""The registered model queries fit the library's default models and full grids."""

import pytest

from caliper.operators import models as MO
from caliper.plans import catalog


class Reached(Exception):
    pass


@pytest.fixture()
def asked(monkeypatch):
    """What the queries ask the library for; nothing is fitted."""
    calls = []

    def note(what):
        def call(*args, **named):
            calls.append((what, args, named))
            raise Reached
        return call

    for module, name in ((catalog.MO, "fit_model"), (catalog.MO, "fit_and_select"), (catalog.RE, "cv_reliability"), (catalog.RE, "ablation"),
                         (catalog.RE, "time_holdout"), (catalog.RE, "spatial_holdout")):
        monkeypatch.setattr(module, name, note(name))
    monkeypatch.setattr(catalog, "_ml_split", lambda spark, d: (None, None))
    monkeypatch.setattr(catalog.R, "prepared_checkpointed", lambda *args: None)
    return calls


@pytest.mark.parametrize("query", ["fit_logistic", "fit_forest", "fit_boosting", "model_selection", "batch_score", "stored_model_eval",
                                   "calibrated_model", "model_importance", "permutation_importance", "cv_reliability", "time_holdout",
                                   "spatial_holdout", "ablation"])
def test_queries_fit_the_defaults(asked, query):
    with pytest.raises(Reached):
        catalog.EXACT[query](None, "")
    (what, args, named), = asked
    assert not named.get("params")
    if what == "fit_model":
        assert len(args) == 5 or not args[5]


@pytest.mark.parametrize("query", ["time_holdout", "spatial_holdout"])
def test_refits_use_the_selected_parameters(asked, monkeypatch, query):
    best = MO.FittedModel("random_forest", None, None, [], [], [], params={"num_trees": 7})
    monkeypatch.setattr(catalog, "_selected", lambda spark, d: (best, None, None, None))
    with pytest.raises(Reached):
        catalog.EXACT[query](None, "")
    assert asked[0][0] == query and asked[0][1][-1] == {"num_trees": 7}


def test_the_search_has_the_full_grids(asked, monkeypatch):
    seen = []

    class Trials:
        def unionByName(self, other):
            return self

    monkeypatch.setattr(catalog.RE, "search_rows", lambda *args, **named: ("folds", args[1:], named))
    monkeypatch.setattr(catalog.RE, "grid_search", lambda train, name, grid, *args, **named: (seen.append((name, grid, named)), Trials()))
    catalog.EXACT["grid_search"](None, "")
    shared = ("folds", (catalog.R.NUMERIC_FEATURES, catalog.R.CATEGORICAL_FEATURES), {})
    assert sorted(seen, key=lambda s: MO.MODEL_ORDER.index(s[0])) == [(name, MO.PARAM_GRIDS[name], {"shared": shared}) for name in MO.MODEL_ORDER]


def test_forests_of_all_queries_draw_from_all_rows():
    import itertools
    grid = MO.PARAM_GRIDS["random_forest"]
    points = [None, *(dict(zip(grid, values)) for values in itertools.product(*grid.values()))]
    for point in points:
        how = MO.tree_settings("random_forest", point)
        assert all(how.rate(n) == 1.0 for n in (1, 20_001, 432_244, 10**9))
