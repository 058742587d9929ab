"""Marks come to the papers; sentences and their translations are not moved."""

from quire.plans import load
from tests.test_movement import DATA, shuffles, unbroadcast  # noqa: F401


def test_sentences_stay_with_their_paper(unbroadcast):  # noqa: F811
    moved = shuffles(load()[0]["S7_ris_export"](unbroadcast, DATA))
    assert moved and not [x for x in moved if "sid#" in x]
