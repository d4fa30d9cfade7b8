"""Tracks with a life cycle against a plain version that tries all matchings of a frame."""

from functools import lru_cache

import pytest

from chronovec.plans import catalog


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def matching(dets, tracks, bar):
    """Pairs of the matching with the largest total overlap, as far as they reach the bar."""
    over = {(d, t): x for d, box in dets.items() for t, track in tracks.items() if (x := iou(box, track)) > 0}
    order = sorted(dets)

    @lru_cache(None)
    def best(k, used):
        if k == len(order):
            return 0.0, ()
        found = best(k + 1, used)
        for (d, t), x in over.items():
            if d == order[k] and t not in used:
                total, pairs = best(k + 1, used | {t})
                found = max(found, (x + total, ((d, t), *pairs)))
        return found

    return [p for p in best(0, frozenset())[1] if 1 - over[p] <= 1 - bar]


def plain(frames, high, bar):
    tracks, made, out = {}, 0, []  # number -> [box, missed, hits]
    for frame, dets in frames:
        for t in tracks.values():
            t[1] += 1
        lost = {n for n, t in tracks.items() if t[1] > 5}
        strong = {d: box for d, (box, s) in dets.items() if s >= high}
        weak = {d: box for d, (box, s) in dets.items() if s < high}
        first = matching(strong, {n: t[0] for n, t in tracks.items() if n not in lost}, bar)
        taken = {n for _, n in first}
        second = matching(weak, {n: t[0] for n, t in tracks.items() if n not in taken}, max(0.1, bar - 0.1))
        for d, n in [*first, *second]:
            tracks[n] = [dets[d][0], 0, tracks[n][2] + 1]
            out.append((frame, d, n, "tracked", tracks[n][2]))
        for d in sorted(set(strong) - {d for d, _ in first}):
            tracks[made] = [strong[d], 0, 1]
            out.append((frame, d, made, "tracked", 1))
            made += 1
        tracks = {n: t for n, t in tracks.items() if t[1] < 30}
    return out


@pytest.mark.parametrize("name", ["n3_lifecycle_tracks"])
def test_tracks_equal_brute_force(spark, sf_dir, name):
    scenes = {}
    for r in catalog.boxes(spark, sf_dir).orderBy("frame", "vec_id").collect():
        scenes.setdefault(r.frame // 25, {}).setdefault(r.frame, {})[r.vec_id] = ((r.x1, r.y1, r.x2, r.y2), r.conf)
    expected = sorted((s, *row) for s, frames in scenes.items() for row in plain(sorted(frames.items()), 0.6, 0.1))
    got = sorted((r.scene, r.frame, r.vec_id, r.track, r.state, r.hits) for r in catalog.QUERIES[name](spark, sf_dir).collect())
    assert got == expected and any(r[5] > 2 for r in got)
