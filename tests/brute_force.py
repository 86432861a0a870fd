"""Brute-force Python versions of the outage semantics (test oracle)."""

from __future__ import annotations

from collections import defaultdict


def outages(rows, since=None, host=None, min_duration=30.0, include_open=False, as_of=None):
    """rows: (id, ts, host, rt, loss, err, created). Returns sorted tuples
    (host, start, end, duration) with the n-th start paired with the n-th end."""
    by_host = defaultdict(list)
    for r in rows:
        if host and r[2] != host:
            continue
        if since is not None and r[1] < since:
            continue
        by_host[r[2]].append(r)
    out = []
    for h, rs in by_host.items():
        rs.sort(key=lambda r: (r[1], r[0]))
        starts, ends = [], []
        prev = None
        for i, r in enumerate(rs):
            loss = r[4]
            p = prev if i else None
            if loss is True and (p is False or p is None):
                starts.append(r[1])
            if loss is False and p is True:
                ends.append(r[1])
            prev = loss
        for n, s in enumerate(starts):
            e = ends[n] if n < len(ends) else None
            if e is None:
                if not include_open:
                    continue
                d = (as_of - s).total_seconds()
            else:
                d = (e - s).total_seconds()
            if d >= min_duration:
                out.append((h, s, e, d))
    return sorted(out, key=lambda t: (t[0], t[1]))
