"""The strongest pairs of a run are those of all its addresses."""

import math

from conftest import DATA

import __spark_entry__ as entry


def brute(cells, reach=5):
    """(a, b) to r of all pairs of a run with |r| above one half; ``cells`` is {address: {token: value}}."""
    _, at = min((-abs(v), t) for values in cells.values() for t, v in values.items())
    names, out = sorted(cells), {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = [(cells[a][t], cells[b][t]) for t in range(at - reach, at + reach + 1) if t in cells[a] and t in cells[b]]
            if len(both) >= 3:
                mx, my = (sum(p[k] for p in both) / len(both) for k in (0, 1))
                den = math.sqrt(sum((x - mx) ** 2 for x, _ in both) * sum((y - my) ** 2 for _, y in both))
                r = sum((x - mx) * (y - my) for x, y in both) / den if den else 0.0
                if abs(r) > 0.5:
                    out[a, b] = r
    return out


def test_pairs_of_all_addresses(spark):
    from tapelark import testmap

    runs = {}
    for r in testmap.long_embeddings(spark, DATA).collect():
        runs.setdefault(r.run_id, {}).setdefault(r.address, {})[r.token_pos] = r.value
    got = {}
    for r in entry.queries()["cooccurrence_pairs"](spark, DATA).collect():
        got.setdefault(r.run_id, {})[r.a, r.b] = r.r
    assert max(map(len, runs.values())) == 64 and set(got) <= set(runs)
    for run, cells in runs.items():
        want = brute(cells)
        best = sorted(want, key=lambda p: (round(abs(want[p]), 6), p), reverse=True)[:5]
        mine = got.get(run, {})
        assert len(mine) == len(best) and all(abs(mine[p] - want[p]) < 2e-6 for p in mine)
        assert all(abs(x - y) < 2e-6 for x, y in zip(sorted(abs(mine[p]) for p in mine), sorted(abs(want[p]) for p in best), strict=True))
