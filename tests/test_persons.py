"""Two persons followed by place and vector: cases by hand in which place and vector disagree."""

from chronovec.operators import stateful

FACE = "s long, f long, id long, conf double, x1 double, y1 double, x2 double, y2 double, v array<double>"
ONE, TWO, NONE = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]


def face(f, i, x, v, size=40, conf=0.9):
    return (0, f, i, conf, float(x), 100.0, float(x + size), float(100 + size), v)


def dual(spark, rows, frames, refs=((0, ONE, TWO),), **how):
    df = spark.createDataFrame(rows, FACE)
    all_frames = spark.createDataFrame([(0, f) for f in range(frames)], "s long, f long")
    known = spark.createDataFrame(list(refs), "s long, ref1 array<double>, ref2 array<double>")
    found = stateful.dual_persons(all_frames, df, known, ["s"], "f", "id", "v", **how).orderBy("f")
    return [(r.person1, r.person2, r.lost1, r.lost2) for r in found.collect()]


def test_gate_comes_before_likeness(spark):
    rows = [
        face(0, 1, 0, NONE), face(0, 2, 500, NONE),  # no place yet: first and second face, whatever they look like
        face(1, 3, 60, ONE), face(1, 4, 300, ONE), face(1, 5, 520, TWO),
        face(2, 6, 300, ONE), face(2, 7, 540, NONE),  # one's double is out of reach, two's neighbour is another: nobody, and nobody counts as lost
        face(4, 8, 150, ONE), face(4, 9, 450, TWO),  # frame 3 had no face
        face(5, 10, 151, [1.0, 0.5, 0.0]), face(5, 11, 152, [1.0, 0.1, 0.0]), face(5, 12, 451, [1.0, 1.0, 0.0]),
    ]
    got = dual(spark, rows, 7)
    assert got == [(1, 2, 0, 0), (3, 5, 0, 0), (None, None, 0, 0), (None, None, 1, 1), (8, 9, 0, 0), (11, 12, 0, 0), (None, None, 1, 1)]


def test_one_face_may_be_both_and_a_fallback_resets_nothing(spark):
    both = [1.0, 1.0, 0.0]
    rows = [face(1, 1, 0, both), face(2, 2, 10, both), face(2, 3, 500, both), face(3, 4, 300, both), face(4, 5, 20, None)]
    # frame 0 is empty; frame 1 gives only person 1 a place, frame 2 gives person 2 the second face
    assert dual(spark, rows, 5, least=0.7) == [(None, None, 1, 1), (1, None, 1, 1), (2, 3, 0, 1), (None, None, 0, 1), (None, None, 0, 1)]
    near = [face(0, 1, 0, both), face(0, 2, 50, both), face(1, 3, 30, both)]
    assert dual(spark, near, 2) == [(1, 2, 0, 0), (3, 3, 0, 0)]
    assert dual(spark, near, 2, refs=[(0, None, TWO)]) == [(1, 2, 0, 0), (None, 3, 0, 0)]
    assert dual(spark, near, 2, refs=[(9, ONE, TWO)])[1] == (None, None, 0, 0)  # no vectors known: nobody is matched


def test_vector_start_ignores_places(spark):
    """The persons swap places in frame 1: vectors follow them, importance does not."""
    rows = [face(0, 1, 940, ONE, 200), face(0, 2, 100, TWO), face(1, 3, 940, TWO, 200), face(1, 4, 100, ONE), face(2, 5, 940, NONE), face(3, 6, 940, [1.0, 0.9, 0.0])]
    df = spark.createDataFrame(rows, FACE)
    known = stateful.opening_references(df.where("f = 0"), ["s"], "f", "id", "conf", "v")
    assert [tuple(r) for r in known.collect()] == [(0, ONE, TWO)]
    how = dict(start=30, v="v", references=known)
    got = [(r.person1, r.person2) for r in stateful.two_slot_tracks(df, ["s"], "f", "id", "conf", **how).orderBy("f").collect()]
    # (cos + 1) / 2 of an unlike face is 0.5, above the bar of 0.4: a face that is nearest to both goes to the more similar, on ties to person 2
    assert got == [(1, 2), (4, 3), (None, 5), (6, None)]
    plain = [(r.person1, r.person2) for r in stateful.two_slot_tracks(df, ["s"], "f", "id", "conf", start=30).orderBy("f").collect()]
    assert plain[:2] == [(1, 2), (3, 4)]


def test_history_of_person_one_ends_the_start(spark):
    """Five places of person 1 and any of person 2 are enough; until the start is over nobody stands in."""
    rows = [face(f, f, 940 + f, ONE) for f in range(5)] + [face(0, 100, 300, TWO)]
    rows += [face(5, 50, 300, TWO), face(5, 51, 945, ONE, 10)]  # expected places, not importance
    df = spark.createDataFrame(rows, FACE)
    got = [(r.person1, r.person2) for r in stateful.two_slot_tracks(df, ["s"], "f", "id", "conf", start=30).orderBy("f").collect()]
    assert got[5] == (51, 50)
