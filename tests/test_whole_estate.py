"""Queries over every element of the estate, against brute force on the smallest tables."""

from strataloom.plans import queries as q


def test_cycles_of_the_whole_estate(spark, sf_dir):
    rows = q.looped(spark, sf_dir).select("id", "parent_id", "kind", "ord").collect()
    up = {r.id: r.parent_id or None for r in sorted(rows, key=lambda r: r.ord)}

    def walk(x):
        seen, at = [], x
        while at is not None and at not in seen:
            seen.append(at)
            at = up.get(at)
        return at

    want = {x: walk(x) == x for x in up if walk(x) is not None}
    assert {r.id: r.on_cycle for r in q.cycles(spark, sf_dir).collect()} == want
    assert any(r.kind == "code" and r.id in want for r in rows)


def test_grid_of_the_whole_estate(spark, sf_dir):
    rows = q.estate(spark, sf_dir)[0].select("id", "ord").collect()
    want = sorted((r.id, 50.0 + n % 3 * 150, 50.0 + n // 3 * 150) for n, r in enumerate(sorted(rows, key=lambda r: r.ord)))
    assert sorted((r.element_id, r.x, r.y) for r in q.grid_layout(spark, sf_dir).collect()) == want
