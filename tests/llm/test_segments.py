"""Probes of a query for the radius that its nearest codes need do not grow as fast as the codes."""

from math import comb

from quire.llm import hamming


def _probes(n, distance):
    """Values that a query probes until all codes within a distance are found."""
    segments, found, radius = hamming.segments_for(n), 0, 0
    while (needed := distance + 1 - len(segments) * radius) > 0:
        found += sum(comb(w, radius) for _, w in segments[: min(needed, len(segments))])
        radius += 1
    return found


def test_five_times_the_codes_do_not_take_five_times_the_probes_of_a_query():
    for distance in (14, 16, 18):
        assert _probes(51282, distance) < 2 * _probes(10256, distance)


def test_segments_cover_a_code():
    for n in (1, 10, 1000, 10256, 51282, 10**8):
        ends = [a + w for a, w in hamming.segments_for(n)]
        assert [a for a, _ in hamming.segments_for(n)] == [0, *ends[:-1]] and ends[-1] == 64
