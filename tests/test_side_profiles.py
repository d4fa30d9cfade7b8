"""Halves of a frame by profile: small cases by hand."""

from chronovec.operators import stateful

KIND = "scene long, frame long, id long, x1 double, y1 double, x2 double, y2 double, v array<double>"
PROFILE = "scene long, side string, ref array<double>, size double, px double, py double"


def face(frame, i, x, size, v):
    return (0, frame, i, float(x), 0.0, float(x + size), float(size), v)


def run(spark, rows, profiles, **how):
    df, known = spark.createDataFrame(rows, KIND), spark.createDataFrame(profiles, PROFILE)
    return {(r.frame, r.side): (r.id, r.how) for r in stateful.side_profiles(df, known, ["scene"], "frame", "id", "v", 500.0, **how).collect()}


def test_vector_size_and_place_each_decide(spark):
    alike = [1.0, 0.0]
    rows = [
        face(0, 1, 0, 40, alike), face(0, 2, 100, 40, [-1.0, 0.0]), face(0, 3, 300, 90, [0.0, 1.0]),  # the vector decides
        face(1, 4, 0, 40, alike), face(1, 5, 100, 40, alike),  # only the place differs: the far one loses, though it is first
        face(2, 6, 100, 90, alike), face(2, 7, 100, 40, alike),  # only the size differs
        face(3, 8, 400, 90, [-1.0, 0.0]), face(3, 9, 450, 20, [-1.0, 0.0]),  # nothing fits: the largest
        face(3, 10, 900, 20, alike), face(3, 11, 700, 30, alike),  # a half without a profile: always the largest
    ]
    got = run(spark, rows, [(0, "L", [2.0, 0.0], 1600.0, 120.0, 20.0)])
    assert got == {(0, "L"): (1, "profile"), (1, "L"): (5, "profile"), (2, "L"): (7, "profile"), (3, "L"): (8, "largest"), (3, "R"): (11, "largest")}


def test_parts_that_are_missing_leave_the_mean(spark):
    # place alone, 100 of 200 px away: 0.5; with a vector that differs: 0.2 * 0.5 / 0.8
    rows = [face(0, 1, 100, 20, [-1.0, 0.0])]
    assert run(spark, rows, [(0, "L", None, None, 210.0, 10.0)])[(0, "L")] == (1, "profile")
    assert run(spark, rows, [(0, "L", [1.0, 0.0], None, 210.0, 10.0)])[(0, "L")] == (1, "largest")
    assert run(spark, rows, [(0, "L", None, None, 210.0, 10.0)], least=0.5)[(0, "L")] == (1, "largest")  # strictly above


def test_matched_vectors_join_the_bank_and_others_do_not(spark):
    rows = [face(f, 10 * f, 0, 20, v) for f, v in enumerate([[1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [-1.0, -1.0], [0.0, 1.0]])]
    rows += [face(4, 41, 200, 90, [1.0, -0.2])]
    # the bank has turned from (1, 0) to (1, 1): now the first of frame 4 fits better
    assert run(spark, rows, [(0, "L", [1.0, 0.0], None, None, None)])[(4, "L")] == (40, "profile")
    assert run(spark, rows, [(0, "L", [1.0, 0.0], None, None, None)], bank=64)[(3, "L")] == (30, "largest")
    assert run(spark, rows[4:], [(0, "L", [1.0, 0.0], None, None, None)])[(4, "L")] == (41, "profile")
