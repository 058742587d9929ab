"""Requests stay with their paper; only the answers come back to them."""

from quire.operators import model_apply as P
from quire.plans import load
from tests.test_movement import DATA, shuffles, unbroadcast  # noqa: F401


def test_requests_stay_with_their_paper(unbroadcast, monkeypatch):  # noqa: F811
    staged = []
    monkeypatch.setattr(P, "stage_table", lambda df, name: (staged.append(df), df)[1])
    load()[0]["E2_model_apply"](unbroadcast, DATA)
    moved = shuffles(staged[0])
    assert len(moved) == 1 and not [x for x in moved if "page#" in x or "batch#" in x]
