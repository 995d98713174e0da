"""A plain-Python simulator of the gather-apply-scatter rounds, for comparison."""

from collections import defaultdict

INF = 1 << 30


class Sim:
    def __init__(self, raw):
        self.ids = sorted({x for e in raw for x in e})
        self.inn, self.out = defaultdict(list), defaultdict(list)
        for s, d in raw:
            if s != d:
                self.out[s].append(d)
                self.inn[d].append(s)

    def both(self, v):
        return self.inn[v] + self.out[v]

    def run(self, init, around, gather, op, zero, apply, ahead, scatter, cap):
        val, active, counts = {}, set(), []
        for v in self.ids:
            val[v], on = init(v)
            if on:
                active.add(v)
        for _ in range(cap):
            total = {}
            for v in active:
                acc = zero
                for n in around(self, v):
                    acc = op(gather(self, val, v, n), acc)
                total[v] = acc
            changed = set()
            new = dict(val)
            for v in active:
                new[v], c = apply(v, val[v], total[v])
                if c:
                    changed.add(v)
            val = new
            active = {n for v in changed for n in ahead(self, v) if scatter(val, v, n)}
            counts.append(len(active))
            if not active:
                break
        return val, counts

    def pagerank(self, cap=32):
        return self.run(lambda v: (1.0, True), lambda s, v: s.inn[v], lambda s, val, v, n: val[n] / len(s.out[n]), lambda a, b: a + b, 0.0, lambda v, old, t: (0.15 * t + 0.85, True), lambda s, v: s.out[v], lambda val, v, n: True, cap)

    def sssp(self, source, cap=64):
        def apply(v, old, t):
            new = 0 if v == source else min(old, t + 1)
            return new, new != old

        return self.run(lambda v: (INF, v == source), lambda s, v: [] if v == source else s.inn[v], lambda s, val, v, n: val[n], min, INF, apply, lambda s, v: s.out[v], lambda val, v, n: val[v] + 1 < val[n], cap)

    def cc(self, cap=32):
        return self.run(lambda v: (v, True), lambda s, v: s.both(v), lambda s, val, v, n: val[n], min, INF, lambda v, old, t: (min(old, t), min(old, t) != old), lambda s, v: s.both(v), lambda val, v, n: val[v] < val[n], cap)

    def kcore(self, k, cap=50):
        return self.run(lambda v: (k, True), lambda s, v: s.both(v), lambda s, val, v, n: int(val[n] >= k), lambda a, b: a + b, 0, lambda v, old, t: (t, t < k), lambda s, v: s.both(v), lambda val, v, n: val[n] >= k, cap)
