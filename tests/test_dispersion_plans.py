"""Label queries never gather a label's rows in one task."""

from conftest import SF_SMALL
from consonance.operators import vectors as V
from consonance.plans import registry


def test_labels_are_not_scored_by_the_direct_form(spark, monkeypatch):
    groups, direct = [], V.group_spectra
    monkeypatch.setattr(V, "group_spectra", lambda df, cols, *a, **b: groups.append(cols) or direct(df, cols, *a, **b))
    for key in ("f7_kernel_moments", "f7_kernel_moments_gram_path", "f7_kernel_moments_by_conversation"):
        registry.queries()[key](spark, SF_SMALL)
    assert groups == [["conv_id"]]
