import random
from itertools import product

from leadtide.operators.roles import best_assignment, facts, role_candidates, suggested_roles


def _brute(candidates):
    roles = sorted({r for _, r, _ in candidates})
    options = [[(p, n) for p, x, n in candidates if x == r] + [None] for r in roles]
    best = None
    for way in product(*options):
        used = [x[0] for x in way if x]
        if len(set(used)) == len(used):
            key = (-sum(x[1] for x in way if x), [x[0] if x else 10**6 for x in way])
            if best is None or key < best[0]:
                best = (key, {r: x for r, x in zip(roles, way, strict=True) if x})
    return best[1] if best else {}


def test_the_assignment_is_the_best_of_all():
    draw = random.Random(2)
    for _ in range(150):
        columns = draw.randint(1, 6)
        found = [(p, r, draw.choice((200, 400, 500, 1000))) for p in range(columns) for r in "abcd" if draw.random() < 0.6]
        assert best_assignment(found) == _brute(found)
    assert best_assignment([]) == {}


def test_one_column_isn_t_taken_twice(spark):
    # Both times could be the timestamp; the price is also the best-named number, yet the target needs one too.
    rows = [(i % 5, f"2024-01-{1 + i % 28:02d}", float(i % 7), 10.0 + i % 3, "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "store_code int, `Check-in Date` string, amount double, price double, room_type string")
    found = {r.role: r.column for r in suggested_roles(df).collect()}
    assert found == {"entity_id": "store_code", "timestamp": "Check-in Date", "target": "amount", "price": "price", "category": "room_type"}


def test_columns_that_fit_nothing(spark):
    df = spark.createDataFrame([(i, 1, None, -1.0 - i) for i in range(30)], "id int, city_code int, day string, price double")
    found = {(r.column, r.role): r.points for r in role_candidates(df).collect()}
    assert not any(c in ("city_code", "day") for c, _ in found)  # one value, no value
    assert found["id", "entity_id"] == 300 and ("price", "price") not in found
    empty = df.filter("id < 0")
    assert role_candidates(empty).collect() == [] and suggested_roles(empty).collect() == []
    assert [r["rows"] for r in facts(empty).collect()] == [0] * 4
