"""Registered model queries run the whole job of their operators."""

import pytest

from barloom.catalog import flows, modelling


class Seen(Exception):
    pass


@pytest.mark.parametrize(("query", "owner", "name"), [("backward_elimination", modelling.models, "backward_elimination"), ("label_evidence", modelling.models, "evidence_for"), ("feature_screening", flows.screening, "screen")])
def test_no_cap(spark, sf, monkeypatch, query, owner, name):
    def look(*args, **named):
        raise Seen(args, named)

    monkeypatch.setattr(owner, name, look)
    with pytest.raises(Seen) as seen:
        {**modelling.QUERIES, **flows.QUERIES}[query](spark, sf)
    args, named = seen.value.args
    if query == "feature_screening":
        assert args[5].wrapper_rounds is None
        assert set(modelling.COLS) <= set(args[1])
    else:
        assert list(args[2]) == modelling.COLS and named.get("max_rounds") is None
