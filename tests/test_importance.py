"""Importances need the refitted winner, not its scores of the held-out rows."""

from turnaround.operators import forest, modelling
from turnaround.plans import catalog


def test_importances_score_no_test_rows(spark, sf_dir, monkeypatch):
    scored, real = [], forest.ForestModel._transform
    monkeypatch.setattr(catalog, "_made", {})
    monkeypatch.setattr(catalog, "candidates", lambda: {modelling.FOREST: modelling.forest(trees=3, depth=4)})
    monkeypatch.setattr(forest.ForestModel, "_transform", lambda self, rows: scored.append(rows) or real(self, rows))
    table = catalog._importance(spark, sf_dir)
    assert len(scored) == 1  # validation rows, for the comparison
    assert table.where("rank = 1").first().importance > 0
    assert catalog._best(spark, sf_dir)["metrics"].count() and len(scored) == 2  # the same refit, then scored
