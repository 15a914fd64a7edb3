import math
import random

import pytest

from zygospan.operators.hmm import state_crossovers, transmission_states


def whole_scan(sites, rate, eps=0.001):
    """Log-space forward-backward and best path over one unsplit sequence."""
    def add(a, b):
        hi, lo = max(a, b), min(a, b)
        return hi + math.log1p(math.exp(lo - hi))

    def move(d):
        p = min(max(0.5 * (1 - math.exp(-2 * d * rate / 1e8)), 1e-15), 0.5 - 1e-12)
        return [[math.log(1 - p), math.log(p)], [math.log(p), math.log(1 - p)]]

    e = [[math.log(1 - eps) if o == q else math.log(eps) for q in pq] for _, pq, o in sites]
    n = len(sites)
    f, v = [[math.log(0.5) + x for x in e[0]]], [[math.log(0.5) + x for x in e[0]]]
    ptr = [None]
    for i in range(1, n):
        t = move(sites[i][0] - sites[i - 1][0])
        f.append([add(f[-1][0] + t[0][s], f[-1][1] + t[1][s]) + e[i][s] for s in (0, 1)])
        c = [[v[-1][r] + t[r][s] for r in (0, 1)] for s in (0, 1)]
        ptr.append([0 if x[0] >= x[1] else 1 for x in c])
        v.append([max(c[s]) + e[i][s] for s in (0, 1)])
    b = [[0.0, 0.0]]
    for i in range(n - 2, -1, -1):
        t = move(sites[i + 1][0] - sites[i][0])
        b.insert(0, [add(t[s][0] + e[i + 1][0] + b[0][0], t[s][1] + e[i + 1][1] + b[0][1]) for s in (0, 1)])
    post = [1 / (1 + math.exp(f[i][1] + b[i][1] - f[i][0] - b[i][0])) for i in range(n)]
    path = [0 if v[-1][0] >= v[-1][1] else 1]
    for i in range(n - 1, 0, -1):
        path.insert(0, ptr[i][path[0]])
    return post, path


@pytest.mark.parametrize("block", [50_000, 400_000, 10**9])
def test_blocks_equal_whole_scan(spark, block):
    rng = random.Random(5)
    rows, truth = [], {}
    for trio in range(4):
        pos = sorted(rng.sample(range(1, 2_000_000), 150))
        hidden, sites = rng.randrange(2), []
        for p in pos:
            if rng.random() < 0.03:
                hidden = 1 - hidden
            pq = (0, 1) if rng.random() < 0.5 else (1, 0)
            seen = pq[hidden] if rng.random() > 0.05 else pq[1 - hidden]
            sites.append((p, pq, seen))
            rows.append((trio, "paternal", 21, p, pq[0], pq[1], seen))
        truth[trio] = (pos, *whole_scan(sites, 50.0))
    df = spark.createDataFrame(rows, "trio int, parent string, chrom int, pos long, p0 int, p1 int, observed int")
    states = transmission_states(df, 50.0, block=block)
    got = states.collect()
    for trio, (pos, post, path) in truth.items():
        mine = sorted((r.pos, r.p0, r.state) for r in got if r.trio == trio)
        assert [m[0] for m in mine] == pos
        assert max(abs(m[1] - p) for m, p in zip(mine, post)) < 1e-9
        assert [m[2] for m in mine] == path
    want = {
        (t, pos[i]) for t, (pos, post, path) in truth.items() for i in range(1, len(pos))
        if path[i] != path[i - 1] and (post[i] if path[i] == 0 else 1 - post[i]) >= 0.95
    }
    assert {(r.trio, r.new_pos) for r in state_crossovers(states).collect()} == want
