"""Tail probabilities against published results of the same tests (fixed values)."""

import pytest

from tierstats.functions import exact

#: n1, n2, u, p without ties: two published values, then textbook values.
MANN_WHITNEY = [(69, 11, 579.0, 0.005432086343162083), (69, 11, 238.0, 0.04884871036087281), (3, 3, 9.0, 0.1), (5, 5, 25.0, 2 / 252), (4, 6, 12.0, 1.0)]
#: n, smaller rank sum, p without ties and zeros.
WILCOXON = [(25, 1.0, 1.1920928955078125e-07), (25, 25.0, 5.3882598876953125e-05), (5, 0.0, 0.0625)]
#: h, groups, p
KRUSKAL = [(4.454545454545453, 2, 0.03480847881186722), (5.945769230769244, 3, 0.05115553325613792), (3.3333333333333357, 2, 0.0678891548618288)]


@pytest.mark.parametrize("n1, n2, u, p", MANN_WHITNEY)
def test_mann_whitney(n1, n2, u, p):
    assert exact.mann_whitney_p(n1, n2, u, 0.0) == pytest.approx(p, rel=1e-9)
    assert exact.mann_whitney_p(n2, n1, n1 * n2 - u, 0.0) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("n, w, p", WILCOXON)
def test_wilcoxon(n, w, p):
    assert exact.wilcoxon_p(n, w, 0.0, 0) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("h, k, p", KRUSKAL)
def test_chi_square_tail(h, k, p):
    assert exact.chi2_tail(h, k - 1) == pytest.approx(p, rel=1e-12)


def test_other_tails():
    assert exact.fisher_p(3, 1, 1, 3) == pytest.approx(0.4857142857142857)
    assert exact.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074039, rel=1e-9)
    assert exact.correlation_p(0.5, 2) is None and exact.correlation_p(1.0, 5) == 0.0
    assert exact.wilcoxon_p(0, 0.0, 0.0, 3) is None
    assert sum(exact.u_counts(4, 5)) == 126 and sum(exact.signed_rank_counts(6)) == 64
